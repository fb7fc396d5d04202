"""Text expressions: tokens, blank test, newline and accent normalisation, HTML to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word and as blank text.
WORD = r"[\p{L}\p{N}]+"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"

# Accented letters and their plain forms, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Elements whose end starts a new line, and the entities that are decoded.
BLOCK_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def tokens(text: Column, fold: bool = False) -> Column:
    """Lower-cased words in reading order."""
    low = F.lower(text)
    return F.regexp_extract_all(fold_accents(low) if fold else low, F.lit(f"({WORD})"), F.lit(1))


def is_non_blank(text: Column) -> Column:
    """True where stripping white space leaves something."""
    return text.rlike(NOT_BLANK)


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def html_text(html: Column) -> Column:
    """Readable text of an HTML page, one line per block element."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    out = F.regexp_replace(out, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r\f]+", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return F.btrim(out, F.lit(" \n"))
