"""Quality rule: how well public vocabularies fit a text, with rejection bands per language or script.

Null and empty texts have no words, fail the base rule and are not kept. Whole texts are measured whatever their length.
Equal rows get equal verdicts. Bands follow from counts over all documents that pass the base rule; a group
that no such document belongs to has no band and rejects nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.batches import struct_column
from daybook.runtime import durable

VOCAB_DIR = "/opt/tokenizers"
VOCABULARY = "piece_bpe_32k.model"

#: The characters that count as symbols, and white space between words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
    "n_tokens long, token_chars double, fallback double, entropy double"
)
#: Measure, smallest spread taken for a band, side that a band rejects (-1 low, 1 high, 0 both).
#: Tokens in a block whose entropy is taken.
BLOCK = 64
BANDS = (("token_chars", 0.08, 0), ("fallback", 0.02, 1), ("entropy", 0.05, -1))
#: Words a worker remembers, and bytes beyond which a word is not kept for the next texts.
CACHE_WORDS, LONG_WORD = 700_000, 4096


class Numbers(dict):
    """Numbers for keys in the order of their first look-up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Vocabulary:
    """Token ids of single words in flat arrays; each word is encoded once while it is remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        """Forget all words; the index starts again from nothing, so memory stays bounded."""
        self.known = Numbers()
        self.tokens, self.starts, self.longest = np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def index(self, words: list[bytes]) -> np.ndarray:
        """A number for each word; new words are encoded together, each as it stands after a space."""
        had = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        new = list(islice(self.known, had, None))
        if new:
            ids = self.pieces.encode([w.decode("utf-8") for w in new], num_threads=1)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.longest = max(self.longest, max(map(len, new)))
            self.tokens = np.concatenate([self.tokens, np.fromiter(chain.from_iterable(ids), np.int32, lengths.sum())])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        return at

    def measure(self, at: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text (words `edges[k]:edges[k+1]` of `at`): tokens, byte-fallback tokens, mean entropy of token blocks."""
        n = len(edges) - 1
        owner = np.repeat(np.arange(n), np.diff(edges))
        lengths = self.starts[at + 1] - self.starts[at]
        first = np.cumsum(lengths) - lengths
        tokens = self.tokens[np.repeat(self.starts[at] - first, lengths) + np.arange(lengths.sum())]
        of = np.repeat(owner, lengths)
        total = np.bincount(of, minlength=n)
        # Entropy in blocks of equal length, so that texts of any length compare; only full blocks count.
        block = (np.arange(len(tokens)) - (np.cumsum(total) - total)[of]) // BLOCK
        full = block < (total // BLOCK)[of]
        per_text = total // BLOCK
        block = (block + (np.cumsum(per_text) - per_text)[of])[full]
        size = len(self.is_byte)
        pairs, counts = np.unique(block * size + tokens[full], return_counts=True)
        inside = np.bincount(pairs // size, counts * np.log2(counts), per_text.sum())
        owners = np.repeat(np.arange(n), per_text)
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = np.bincount(owners, np.log2(BLOCK) - inside / BLOCK, n) / per_text
        return total, np.bincount(of, self.is_byte[tokens], n), entropy


@lru_cache(maxsize=1)
def vocabulary_of(path: str) -> Vocabulary:
    """One vocabulary per Python worker, so that later tasks find the words that earlier ones encoded."""
    return Vocabulary(path)


def repeated_words(words: list, window: int = 5) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    runs = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(runs)) == len(runs):
        return 0
    often = Counter(runs)
    hit = np.zeros(len(words) + 1, np.int64)
    for i, run in enumerate(runs):
        if often[run] > 1:
            hit[i] += 1
            hit[i + window] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def script_of(text: str) -> str:
    """The commonest script among the letters of a text, by block; `none` without letters."""
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else "none"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edges = np.array([0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0xE00, 0x1100, 0x2E80, 0x3040, 0x3100, 0xAC00])
    names = ["none", "latin", "other", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "other", "other", "other", "kana", "han", "hangul"]
    digits = (codes < 0x41) | ((codes > 0x5A) & (codes < 0x61)) | ((codes > 0x7A) & (codes < 0xC0))
    found = np.bincount(np.searchsorted(edges, codes[~digits], side="right"), minlength=len(names))
    found[0] = 0
    return names[int(found.argmax())] if found.any() else "none"


def suspects(at: np.ndarray, edges: np.ndarray, window: int = 5) -> set[int]:
    """Texts in which two windows of word numbers have equal mixed keys; only they can hold a repeated window."""
    runs = len(at) - window + 1
    if runs < 2:
        return set()
    key = np.zeros(runs, np.uint64)
    for i in range(window):
        key = (key ^ at[i : i + runs].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    whole = owner[:runs] == owner[window - 1 :]
    key, owner = (key ^ (owner[:runs].astype(np.uint64) << np.uint64(40)))[whole], owner[:runs][whole]
    order = np.argsort(key)
    return set(owner[order][1:][key[order][1:] == key[order][:-1]].tolist())


def measure_texts(path: str) -> Callable[[list], list[tuple]]:
    vocabulary = vocabulary_of(path)

    def run(texts: list) -> list[tuple]:
        if len(vocabulary.known) > CACHE_WORDS or vocabulary.longest > LONG_WORD:
            vocabulary.clear()
        texts = [t or "" for t in texts]
        words = [t.encode("utf-8").split() for t in texts]
        edges = np.cumsum([0, *map(len, words)])
        at = vocabulary.index([w for x in words for w in x])
        double = suspects(at, edges)
        out = []
        for k, (text, own, n, in_bytes, entropy) in enumerate(zip(texts, words, *vocabulary.measure(at, edges), strict=True)):
            lines = [x for x in text.split("\n") if x.strip(BLANKS)]
            chars = len(text) - sum(map(text.count, BLANKS))
            measures = (chars / n, in_bytes / n, entropy if n >= BLOCK else None) if n else (None,) * 3
            out.append((
                len(own), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(own) if k in double else 0,
                script_of(text), int(n), *measures,
            ))
        return out

    return run


def measured(text: Column, vocabulary: str) -> Column:
    """A struct of the base counts and of the vocabulary's measures for each text. `vocabulary` is a path on every executor."""
    return struct_column(lambda: measure_texts(vocabulary), MEASURES)(text)


def bands(measures: DataFrame, group: str, min_tokens: int) -> DataFrame:
    """Quartiles and spread of each measure by group, from histograms over all rows.

    A histogram has one row per group and hundredth, so it stays small and its quartiles are exact and repeatable.
    """
    rows = measures.where(~F.col("base_failed") & (F.col("n_tokens") >= min_tokens))
    long = rows.select(
        group, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * 500).cast("long").alias("bin")) for m, _, _ in BANDS))).alias("v")
    ).groupBy(group, "v.measure", "v.bin").count()
    within = Window.partitionBy(group, "measure")
    upto = F.sum("count").over(within.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = long.select(group, "measure", "bin", upto.alias("upto"), F.sum("count").over(within).alias("all"))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("bin"))) / 500.0
    quartiles = ranked.groupBy(group, "measure").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    floor = F.create_map(*(F.lit(x) for m, f, _ in BANDS for x in (m, f)))
    spread = F.greatest(F.col("q3") - F.col("q1"), floor[F.col("measure")])
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    return quartiles.groupBy(group).agg(
        *(x for m, _, _ in BANDS for x in (pick(m, F.col("q1")).alias(f"{m}_q1"), pick(m, F.col("q3")).alias(f"{m}_q3"), pick(m, spread).alias(f"{m}_spread")))
    )


def outside(reach: float) -> F.Column:
    """Whether a measure lies beyond its band. A text of few tokens is a small sample, so its band is wider."""
    wide = reach * (1 + 2 * F.sqrt(BLOCK / F.greatest(F.col("n_tokens"), F.lit(1))))
    out = F.lit(False)
    for m, _, side in BANDS:
        if side <= 0:
            out = out | F.coalesce(F.col(m) < F.col(f"{m}_q1") - wide * F.col(f"{m}_spread"), F.lit(False))
        if side >= 0:
            out = out | F.coalesce(F.col(m) > F.col(f"{m}_q3") + wide * F.col(f"{m}_spread"), F.lit(False))
    return out


def fertility_rule(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
    min_tokens: int = BLOCK, reach: float = 2.0, vocabulary: str = os.path.join(VOCAB_DIR, VOCABULARY),
) -> DataFrame:
    """One row per document: base counts, measures, the group whose band applies and whether the document is kept.

    The group is the language if it is given, else the commonest script. Texts of fewer than `min_tokens` tokens are too
    short for a band and pass it. `reach` is the distance from the quartiles in units of their difference.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), measured(F.col(text_col), vocabulary).alias("m"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = durable(
        rows.select("doc_id", "m.*", F.coalesce("lang", F.concat(F.lit("script:"), "m.script")).alias("band_group")).withColumn("base_failed", failed)
    )
    found = rows.join(bands(rows, "band_group", min_tokens), "band_group", "left")
    kept = ~F.col("base_failed") & ~((F.col("n_tokens") >= min_tokens) & outside(reach))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        "band_group", "n_tokens", *(m for m, _, _ in BANDS),
    )
