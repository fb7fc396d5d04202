"""Texts to vectors with a pluggable encoder, the same one for documents and queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.vectors import DIM, HASHED, hashed_encoder


@dataclass(frozen=True)
class Encoder:
    """A named text-to-vector column function of fixed dimension."""

    name: str
    dim: int
    encode: Callable[[Column], Column]


def default_encoder(dim: int = DIM) -> Encoder:
    return Encoder(f"{HASHED}-{dim}", dim, hashed_encoder(dim))


def embed_texts(rows: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Add `vec`: one vector per row, from the whole text. Row-local, nothing is shuffled."""
    return rows.withColumn("vec", encoder.encode(F.col(text)))


@dataclass(frozen=True)
class IndexState:
    """Size of a vector index and the id that comes next, also after vectors were removed."""

    size: int
    next_id: int


def index_state(vectors: DataFrame, encoder: Encoder) -> IndexState:
    """Read the state in one pass; refuse to go on with another encoder or dimension."""
    other = (F.col("encoder") != encoder.name) | (F.col("dim") != encoder.dim)
    row = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max("id") + 1, F.lit(0)).alias("next_id"),
        F.max(F.when(other, F.concat_ws("/", "encoder", F.col("dim").cast("string")))).alias("other"),
    ).first()
    if row.other is not None:
        raise ValueError(f"index holds {row.other} vectors, not {encoder.name}/{encoder.dim}")
    return IndexState(row.n, row.next_id)
