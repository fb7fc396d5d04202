"""Language identification with a string kernel: presence of n-grams, Nystroem landmarks, one-versus-rest kernel ridge.

The kernel of two texts is the number of n-grams (all lengths from `low` to `high`) present in both, divided by the
geometric mean of their own numbers. A bounded sample per language is learned from; every whole text is scored.
Null texts and texts without a letter are `und` with score 0. Repeated rows get equal answers; without a labelled row
everything is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.batches import struct_column

#: Rows learned from, and landmarks among them, per language.
SAMPLE, LANDMARKS = 160, 32
LOW, HIGH, RIDGE = 1, 3, 0.05
UNKNOWN = "und"
#: Keeps packed n-grams of different length apart; three code points fill the lower 63 bits.
MARK = np.array([1 << 63, 3 << 62, 0], np.uint64)
#: Numbers, and the keys, digests and addresses that hold them, are no words of a language.
NUMBERS = re.compile(r"[A-Za-z0-9+/_=-]*\d[A-Za-z0-9+/_=-]*")
LETTERS = re.compile(r"[^\W\d_]+")
#: Trigrams judged together, and the texts that a language must have in the sample to be judged.
STRETCH, FEW = 256, 8
#: Of a language's sample, all but one in a hundred texts have at most u unknown trigrams; texts may have `WIDE` * u. Least u.
WIDE, LEAST_UNKNOWN, ERRORS = 5, 0.02, 2


def ngrams(text: str, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """Distinct n-grams of a lower-cased text as packed code points, 21 bits each (so `high` is 3 at most)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    parts, packed = [], np.zeros(len(codes), np.uint64)
    for n in range(1, min(high, len(codes)) + 1):
        packed = (packed[: len(codes) - n + 1] << np.uint64(21)) | codes[n - 1 :]
        if n >= low:
            run = np.sort(packed)
            parts.append(run[np.concatenate([[True], run[1:] != run[:-1]])] | MARK[n - 1])
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text's words in order, repeats included, packed as in `ngrams`. Words begin and end with a space."""
    words = " ".join(LETTERS.findall(NUMBERS.sub(" ", text.lower())))
    if not words:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]


class KnownTrigrams:
    """Whether a text is in a learned language at all: the share of its trigrams that the language's sample holds.

    The share falls with the distance from the language, which the score does not. Its bound comes from the sample: each text is held against
    the other texts of its language. A language with a tighter sample than most gets the bound of the middle one. Stretches of a text are
    judged by the language that fits each best, so a text in several learned languages counts as learned. Sample texts alike count once.
    """

    def __init__(self, samples: list[tuple[str, np.ndarray, np.ndarray]]):
        """`samples` has (language, distinct trigrams, their numbers) of each text."""
        alike = {(lang, own.tobytes(), n.tobytes()): (lang, own, n) for lang, own, n in samples if len(own)}
        self.labels, unknown, found = sorted({lang for lang, *_ in alike.values()}), {}, {}
        for lang in self.labels:
            texts = [(own, n) for other, own, n in alike.values() if other == lang]
            found[lang], holders = np.unique(np.concatenate([own for own, _ in texts]), return_counts=True)
            if len(texts) >= FEW:
                alone = [n[holders[np.searchsorted(found[lang], own)] == 1].sum() / n.sum() for own, n in texts]
                unknown[lang] = max(LEAST_UNKNOWN, float(np.quantile(alone, 0.99)))
        middle = float(np.median(list(unknown.values()))) if unknown else 1.0
        self.bounds = {lang: max(0.0, 1 - WIDE * max(u, middle)) for lang, u in unknown.items()}
        self.vocabulary = np.unique(np.concatenate(list(found.values()))) if found else np.empty(0, np.uint64)
        self.present = np.zeros((len(self.vocabulary) + 1, len(self.labels)), np.int32)
        for j, lang in enumerate(self.labels):
            self.present[np.searchsorted(self.vocabulary, found[lang]), j] = 1

    def learned(self, text: str, lang: str) -> bool:
        """Whether a text, predicted as `lang`, is in one of the languages. A language with few samples has no bound: any known trigram will do."""
        own = trigrams(text)
        if not len(own) or not len(self.vocabulary):
            return False
        at = np.searchsorted(self.vocabulary, own)
        at[at == len(self.vocabulary)] = 0
        at[self.vocabulary[at] != own] = len(self.vocabulary)
        starts = np.arange(0, len(own), STRETCH)
        hits = np.add.reduceat(self.present[at], starts, axis=0)
        if lang not in self.bounds and lang in self.labels:
            return bool(hits[:, self.labels.index(lang)].any())
        judged = [j for j, x in enumerate(self.labels) if x in self.bounds]
        if not judged or not hits.any():
            return False
        sizes = np.diff(np.append(starts, len(own)))
        bounds = np.array([self.bounds[self.labels[j]] for j in judged])
        over = hits[:, judged] - sizes[:, None] * bounds
        best = bounds[over.argmax(axis=1)]
        return bool(over.max(axis=1).sum() + ERRORS * np.sqrt((sizes * best * (1 - best)).sum()) >= 0)


class StringKernelModel:
    """Landmarks with their n-grams, and the weights of each language on the kernel row of a text."""

    def __init__(
        self, grams: list[np.ndarray], labels: list[str], landmarks: list[int], ridge: float = RIDGE, known: KnownTrigrams | None = None
    ):
        self.labels, self.known = sorted(set(labels)), known
        marks = [grams[i] for i in landmarks]
        self.vocabulary = np.unique(np.concatenate(marks)) if marks else np.empty(0, np.uint64)
        self.present = np.zeros((len(self.vocabulary), len(marks)), np.float32)
        for j, own in enumerate(marks):
            self.present[np.searchsorted(self.vocabulary, own), j] = 1
        self.scale = 1 / np.sqrt(np.array([max(1, len(x)) for x in marks], np.float32))
        self.weights = np.zeros((len(marks), len(self.labels)))
        if marks:
            rows = self.kernel(grams).astype(np.float64)
            among = rows[landmarks]
            values, vectors = np.linalg.eigh((among + among.T) / 2)
            use = values > 1e-6
            whiten = vectors[:, use] / np.sqrt(values[use])
            features = rows @ whiten
            goal = np.where(np.array(labels)[:, None] == np.array(self.labels)[None, :], 1.0, -1.0)
            weight = 1 / np.array([labels.count(x) for x in labels], np.float64)[:, None]
            left = features.T @ (features * weight) + ridge * np.eye(features.shape[1])
            self.weights = whiten @ np.linalg.solve(left, features.T @ (goal * weight))

    def kernel(self, grams: list[np.ndarray], block: int = 64) -> np.ndarray:
        """Kernel rows of many texts against all landmarks: one matrix product per block of texts."""
        out = np.empty((len(grams), self.present.shape[1]), np.float32)
        for start in range(0, len(grams), block):
            part = grams[start : start + block]
            presence = np.zeros((len(part), len(self.vocabulary)), np.float32)
            for i, own in enumerate(part):
                at = np.searchsorted(self.vocabulary, own)
                at[at == len(self.vocabulary)] = 0
                presence[i, at[self.vocabulary[at] == own]] = 1
            norms = 1 / np.sqrt(np.array([max(1, len(x)) for x in part], np.float32))
            out[start : start + block] = (presence @ self.present) * norms[:, None] * self.scale[None, :]
        return out

    def predict(self, texts: list) -> list[tuple]:
        """(language, score, lead over the second) for each text."""
        grams = [ngrams(t) if t and any(map(str.isalpha, t)) else None for t in texts]
        known = [g for g in grams if g is not None]
        if not self.labels or not known:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        values = np.clip((self.kernel(known) @ self.weights + 1) / 2, 0, 1)
        best = values.argmax(axis=1)
        second = np.sort(values, axis=1)[:, -2] if values.shape[1] > 1 else np.zeros(len(known))
        scored = iter(zip(best.tolist(), values.max(axis=1).tolist(), second.tolist(), strict=True))
        out = []
        for g in grams:
            if g is None:
                out.append((UNKNOWN, 0.0, 0.0))
            else:
                k, top, next_best = next(scored)
                out.append((self.labels[k], round(top, 6), round(top - next_best, 6)))
        return out

    def judge(self, texts: list) -> list[tuple]:
        """(language, score, whether the text is in a learned language) for each text."""
        predicted = zip(texts, self.predict(texts), strict=True)
        return [(lang, score, lang != UNKNOWN and (self.known is None or self.known.learned(t, lang))) for t, (lang, score, _) in predicted]


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents that are never learned from; a missing id is not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learning_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """At most `per_language` rows of each language in the order of a hash of their ids; no language is sorted whole.

    Languages are counted first; a row enters the sort only if its hash lies in a share that holds about four times the
    wanted number, so the sort sees a few hundred rows per language however many the language owns.
    """
    rows = docs.where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    ).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id"), 11) / F.lit(float(1 << 53))).alias("draw")
    # One row per language, as the model has one column per language: small enough for the driver, hence for a broadcast.
    near = rows.select("id", "text", "lang", draw).join(F.broadcast(counts), "lang").where(
        F.col("draw") * F.col("n") < 4 * per_language + 40
    )
    order = Window.partitionBy("lang").orderBy("draw", "id", "text")
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("id", "text", "lang", "k")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE, landmarks: int = LANDMARKS) -> StringKernelModel:
    """Learn from a bounded sample. Executors reduce its texts to n-grams; the driver gets those of the sample only."""
    sample = learning_sample(docs, id_col, text_col, lang_col, per_language)

    def reduced(text: str) -> tuple:
        if not any(map(str.isalpha, text)):
            return None, None, None
        own, n = np.unique(trigrams(text), return_counts=True)
        return ngrams(text).tobytes(), own.tobytes(), n.astype(np.int64).tobytes()

    packed = struct_column(lambda: lambda texts: [reduced(t) for t in texts], "grams binary, trigrams binary, numbers binary")
    rows = sample.select("lang", "k", "id", packed("text").alias("p")).select("lang", "k", "id", "p.*").where(F.col("grams").isNotNull()).collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.k))
    grams = [np.frombuffer(r.grams, np.uint64) for r in rows]
    known = KnownTrigrams([(r.lang, np.frombuffer(r.trigrams, np.uint64), np.frombuffer(r.numbers, np.int64)) for r in rows])
    return StringKernelModel(grams, [r.lang for r in rows], [i for i, r in enumerate(rows) if r.k <= landmarks], known=known)


def scorer(spark, model: StringKernelModel) -> Callable:
    """A column function from a text to (lang_pred, score, lead)."""
    shared = spark.sparkContext.broadcast(model)
    return struct_column(lambda: shared.value.predict, "lang_pred string, score double, lead double")


def judge(spark, model: StringKernelModel) -> Callable:
    """A column function from a text to (lang_pred, score, learned)."""
    shared = spark.sparkContext.broadcast(model)
    return struct_column(lambda: shared.value.judge, "lang_pred string, score double, learned boolean")


def identify(docs: DataFrame, model: StringKernelModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: predicted language, score from 0 to 1, and whether the document was held out."""
    predict = scorer(docs.sparkSession, model)
    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(text_col)).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.lead")
