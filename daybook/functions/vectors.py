"""Vector expressions and the built-in hashed encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.text import tokens
from daybook.schemas import VECTOR

DIM = 768
HASHED = "hashed-tf"
#: Words that a task counts at a time; a longer text is counted by itself.
COUNTED_WORDS = 1 << 18


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    parts = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def has_dim(vec: Column, dim: int) -> Column:
    return F.size(vec) == dim


def _slots(words: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each word."""
    digests = [hashlib.md5(w.encode()).hexdigest() for w in words]
    bucket = np.fromiter((int(d[:8], 16) % dim for d in digests), np.int64, len(words))
    odd = np.fromiter((int(d[8], 16) % 2 for d in digests), np.int64, len(words))
    return bucket, 1.0 - 2.0 * odd


def slices_of(words: pa.ListArray) -> Iterator[tuple[pa.ListArray, pa.Array, np.ndarray, np.ndarray]]:
    """A few rows at a time: (rows, distinct words, and per word its row and its number among the distinct ones).

    What is held beside the given batch is bounded by COUNTED_WORDS or one row.
    """
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, low = np.cumsum(sizes), 0
    while low < len(words):
        most = ends[low] - sizes[low] + COUNTED_WORDS
        high = max(low + 1, int(np.searchsorted(ends, most, side="right")))
        rows = words.slice(low, high - low)
        coded = rows.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        yield rows, coded.dictionary, np.repeat(np.arange(high - low), sizes[low:high]), code
        low = high


def counted(words: pa.ListArray) -> Iterator[tuple[pa.ListArray, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Count the words of each row, a few rows at a time: (rows, distinct words, and of each row's words the row, the word and its count).

    Words stand in the order in which they first occur.
    """
    for rows, terms, doc, code in slices_of(words):
        _, first, tf = np.unique(doc * max(len(terms), 1) + code, return_index=True, return_counts=True)
        order = np.argsort(first)
        first = first[order]
        yield rows, terms, doc[first], code[first], tf[order]


def hashed_encoder(dim: int) -> Callable[[Column], Column]:
    """Text column to a unit vector: log term counts added into signed md5 buckets.

    Words are cut by Spark, one Arrow batch at a time goes to numpy, and no row leaves its
    partition. A word's bucket is its first 32 digest bits modulo `dim`, its sign the parity
    of the next hex digit. Words add up in reading order, so batch limits do not matter.
    """

    @F.arrow_udf(VECTOR)
    def encode(words: pa.Array) -> pa.Array:
        units = [np.zeros(0, np.float32)]
        for rows, terms, doc, code, tf in counted(words):
            bucket, sign = _slots(terms.to_pylist(), dim)
            sums = np.bincount(doc * dim + bucket[code], sign[code] * np.log1p(tf), minlength=len(rows) * dim)
            mat = sums.astype(np.float64).reshape(len(rows), dim)
            norm = np.sqrt((mat * mat).sum(1, keepdims=True))
            units.append(np.divide(mat, norm, out=np.zeros_like(mat), where=norm > 0).astype(np.float32).ravel())
        offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(units)))

    return lambda text: encode(tokens(F.coalesce(text, F.lit(""))))


def batch_encoder(fn: Callable[[list[str]], np.ndarray], rows: int = 32) -> Callable[[Column], Column]:
    """Turn a model call (`list of texts -> matrix`) into an encoder that sees `rows` texts a time."""

    @F.pandas_udf(VECTOR)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[np.ndarray] = []
            for i in range(0, len(texts), rows):
                out.extend(np.asarray(fn(texts.iloc[i:i + rows].tolist()), dtype=np.float32))
            yield pd.Series(out)

    return encode
