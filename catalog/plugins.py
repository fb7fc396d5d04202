"""The three plug-in points with small models written here: an encoder, a refiner and an extractor, some rows failing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import register
from daybook.functions.vectors import batch_encoder
from daybook.operators.embed import Encoder, embed_texts
from daybook.operators.extract import extract_text
from daybook.operators.refine import refine_with


def _letters(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), t.count("e"), t.count(" ")] for t in texts])


@register(
    "plugin_encoder",
    f"""WITH {X.DOCS} SELECT path, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS letters_e,
    (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM docs""",
)
def _(spark, sf):
    """A model that maps lists of texts to a matrix, 32 texts at a time."""
    rows = embed_texts(X.docs(spark, sf), Encoder("letters", 3, batch_encoder(_letters)))
    return rows.select("path", *(F.get("vec", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("chars", "letters_e", "blanks"))))


def _shorten(text: str) -> str:
    if len(text) % 7 == 0:
        raise ValueError("the model is out of words")
    return " " + text.replace("the", "a") + " "


@register(
    "plugin_refiner",
    f"""WITH {X.queries_sql()} SELECT query_id, CASE WHEN length(text) % 7 = 0 THEN text ELSE replace(text, 'the', 'a') END AS text FROM queries""",
)
def _(spark, sf):
    """Where the refiner fails, the query stays as it was."""
    return refine_with(X.queries(spark, sf), _shorten)


def _measure(html: str) -> str:
    if len(html) % 5 == 0:
        raise ValueError("odd page")
    return f"{len(html)} characters"


@register(
    "plugin_extractor",
    """SELECT page_id, CASE WHEN length(html) % 5 <> 0 THEN length(html)::VARCHAR || ' characters' END AS text,
    CASE WHEN length(html) % 5 = 0 THEN 'ValueError: odd page' END AS error FROM pages""",
)
def _(spark, sf):
    """A failing page is reported in its own row and stops no other."""
    return extract_text(X.texts(spark, sf, "pages").select("page_id", "html"), "html", _measure)
