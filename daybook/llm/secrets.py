"""Secret scan: fixed patterns, and credential values judged by the cheapest way to guess them.

Null and empty texts have no spans. Very long texts are scanned whole; a value of any length is one candidate, and its
guess cost is linear in its length times the longest token. Repeated rows give repeated results; an empty table none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.batches import struct_column

# Patterns of the base kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts that a match needs; a text without any of them is not searched.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = ("pass", "pwd", "credential", "key", "auth", "bearer", "pin", "login")

#: Words that name a credential in front of a value, beyond those of the base pattern.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?i:pass_?phrase|pass_?code|pwd|passw|credentials?|private_?key|access_?key|client_?key|auth(?:orization)?|bearer|pin|login|"""
    r"""(?:db|user|root|admin)_?pass)["']?\x20*(?:[:=]|\x20bearer|\x20is)\x20*["']?([^\s"'<>,;]+)""",
    re.ASCII,
)

# Common password words by rank, keyboard rows with their columns aligned, and letters written as digits.
COMMON = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login princess sunshine football shadow baseball superman "
    "trustno hello freedom whatever secret test root user guest default changeme demo example pass access love iloveyou god money "
    "summer winter spring autumn monday january company server system database public private token key abc qwertz azerty"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("013457@$!", "oieastasi")

WORD_RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LONGEST_WORD = 24
#: Dates of each number of digits that a guesser goes through.
DATES = {4: 200, 6: 365 * 100, 8: 365 * 200}
PLACE = {c: (i, j) for i, row in enumerate(ROWS) for j, c in enumerate(row)}
SEPARATED_DATE = re.compile(r"(\d{1,4})([-./_])(\d{1,2})\2(\d{1,4})")


def _neighbours(a: str, b: str) -> bool:
    p, q = PLACE.get(a), PLACE.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _is_date(digits: str) -> bool:
    """Four digits that read as a year, or six or eight as day, month and year in some order."""
    if len(digits) == 4:
        return 1900 <= int(digits) <= 2099
    if len(digits) == 8:
        parts = [(digits[:4], digits[4:6], digits[6:]), (digits[4:], digits[2:4], digits[:2]), (digits[4:], digits[:2], digits[2:4])]
    else:
        parts = [(digits[:2], digits[2:4], digits[4:]), (digits[4:], digits[2:4], digits[:2]), (digits[4:], digits[:2], digits[2:4])]
    return any(
        1 <= int(m) <= 12 and 1 <= int(d) <= 31 and (len(y) == 2 or 1900 <= int(y) <= 2099) for y, m, d in parts
    )


def _alphabet(chars: str) -> int:
    size = 0
    for kind, n in ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26)):
        size += n * any(map(kind, chars))
    return max(2, size + 33 * any(not c.isalnum() for c in chars))


def guess_cost(value: str, own_words: dict[str, int] | None = None) -> tuple[float, str]:
    """Base-10 logarithm of the guesses needed for a value, and the kinds of the cheapest segmentation.

    Dynamic programming over end positions. A segment is a word (common, or of the same text, by rank; capital letters and
    digits for letters cost extra), a date, a repeat, a keyboard walk or a brute-force span. Segments multiply. Time grows with the length.
    """
    own_words = own_words or {}
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    per_char = math.log10(_alphabet(value))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * n

    def offer(start: int, end: int, cost: float, kind: str) -> None:
        total = best[start][0] + max(cost, 0.0) + (0.3 if start else 0.0)
        if total < best[end][0]:
            best[end] = (total, start, kind)

    same = [1] * (n + 1)
    walk = [1] * (n + 1)
    for i in range(1, n):
        same[i] = same[i - 1] + 1 if value[i] == value[i - 1] else 1
        walk[i] = walk[i - 1] + 1 if _neighbours(low[i - 1], low[i]) else 1
    # Per width, how many characters in a row equal the one that many places before.
    told = [0] * 9
    for end in range(1, n + 1):
        last = best[end - 1]
        # A brute-force span grows by one character without a new segment's price.
        if last[2] == "brute" and end > 1:
            best[end] = (last[0] + per_char, last[1], "brute")
        offer(end - 1, end, per_char, "brute")
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            part = low[start:end]
            rank = WORD_RANK.get(part) or own_words.get(part)
            extra = 0.0
            if rank is None and (rank := WORD_RANK.get(plain[start:end])) is not None:
                extra = 0.6
            if rank is not None:
                capital = value[start:end]
                extra += 0.0 if capital == part else 0.3 if capital == part.capitalize() or capital == part.upper() else 1.0
                offer(start, end, math.log10(rank + 1) + extra, "word")
        for width in (4, 6, 8):
            if end >= width and value[end - width : end].isascii() and value[end - width : end].isdigit() and _is_date(value[end - width : end]):
                offer(end - width, end, math.log10(DATES[width]), "date")
        for width in range(8, 11):
            if end >= width and SEPARATED_DATE.fullmatch(value, end - width, end):
                offer(end - width, end, math.log10(365 * 200 * 4), "date")
        for table, kind, least, alphabet in ((same, "repeat", 3, _alphabet(value[end - 1])), (walk, "walk", 4, 40)):
            if table[end - 1] >= least:
                for length in {table[end - 1], min(table[end - 1], least)}:
                    turns = 0.0 if kind == "repeat" else 0.35 * (length - 1)
                    offer(end - length, end, math.log10(alphabet * length) + turns, kind)
        # A block of two to eight characters told again, any number of times.
        for width in range(2, 9):
            told[width] = told[width] + 1 if end > width and value[end - 1] == value[end - 1 - width] else 0
            if told[width] >= width:
                times = told[width] // width + 1
                offer(end - times * width, end, width * math.log10(_alphabet(value[end - width : end])) + math.log10(times), "repeat")
    kinds, at = [], n
    while at > 0:
        kinds.append(best[at][2])
        at = best[at][1]
    return best[n][0], "+".join(reversed(kinds))


def base_spans(text: str, lower: str) -> list[tuple[int, int, str, str]]:
    """(start, kind order, kind, end) of the fixed patterns, leftmost and non-overlapping per kind, with the value."""
    found = []
    for m in ASSIGN.finditer(text) if any(w in lower for w in ASSIGN_WORDS) else ():
        if m.end(2) - m.start(2) >= 6:
            found.append((m.start(), 0, m.end(), m[2], "assign"))
    found += [(m.start(), 1, m.end(), m[0], "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0], "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: x[:2])


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, _, kind in spans)


def _without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text with a space in place of each range; ranges may overlap."""
    kept, at = [], 0
    for start, end in sorted(ranges):
        if end > at:
            kept += [text[at : max(at, start)], " "]
            at = end
    return "".join(kept) + text[at:]


def _reads_as_text(value: str, head: str) -> bool:
    """An ordinary word or hyphenated words behind a colon or "is", as in `login: testing`; an equals sign or a quote makes a value."""
    plain = re.sub(r"[-_/.’]", "", value)
    ordinary = plain.isalpha() and (plain.islower() or plain.isupper() or plain == plain.capitalize())
    return ordinary and "=" not in head and head[-1] not in "\"'"


def scan(text: str | None, strong: float) -> tuple:
    """Base counts and digest, all spans, and the guess costs of credential values.

    A value behind a further credential word becomes a `guess` span if guessing it takes 10**strong tries or more, or if it holds
    password material: dates, walks or repeats, with or without words; or any of these and words beside brute-force spans, unless it reads like
    running text (`_reads_as_text`). A base span that covers it comes first. The text's own words are those that occur outside all values.
    """
    text = text or ""
    lower = text.lower()
    base = base_spans(text, lower)
    n = Counter(kind for *_, kind in base)
    extra, costs = [], []
    context = list(CONTEXT.finditer(text)) if any(w in lower for w in CONTEXT_WORDS) else []
    if base or context:
        values = [(end - len(value), end) for _, _, end, value, _ in base] + [m.span(1) for m in context]
        words = Counter(re.findall(r"[^\W\d_]{3,24}", _without(text, values).lower()))
        ranked = sorted(words.items(), key=lambda x: (-x[1], x[0]))
        own = {w: i + len(COMMON) + 1 for i, (w, _) in enumerate(ranked)}
        costs = [guess_cost(value, own)[0] for _, _, _, value, kind in base if kind == "assign"]
        for m in context:
            value = m[1].rstrip(".!?)")
            start, end = m.start(1), m.start(1) + len(value)
            if len(value) < 6 or any(s < end and start < e for s, _, e, _, _ in base):
                continue
            cost, kinds = guess_cost(value, own)
            parts = set(kinds.split("+"))
            mixed = len(parts) > 1 and not _reads_as_text(value, text[m.start() : m.start(1)])
            if cost >= strong or (mixed if "brute" in parts else len(parts | {"word"}) > 1):
                extra.append((start, 3, end, value, "guess"))
                costs.append(cost)
    spans = sorted(base + extra, key=lambda x: x[:2])
    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
    return (
        n["assign"], n["access"], n["hex"], digest, _joined(spans), len(extra),
        round(min(costs), 6) if costs else None, round(max(costs), 6) if costs else None, sum(c < strong for c in costs),
    )


FIELDS = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, "
    "least_cost double, most_cost double, n_weak long"
)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strong: float = 10.0) -> DataFrame:
    """One row per document with its secret spans; `n_weak` counts credential values below 10**strong guesses."""
    scanned = struct_column(lambda: lambda texts: [scan(t, strong) for t in texts], FIELDS)
    return docs.select(F.col(id_col).alias("doc_id"), scanned(F.col(text_col)).alias("s")).select("doc_id", "s.*")
