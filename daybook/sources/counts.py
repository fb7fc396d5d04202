"""Counters of a stored batch: rows, bytes, oldest and newest instant, observed while the batch is written.

They lie in a hidden file inside the batch's folder, so whatever replaces, rewrites or removes the batch takes them along. A batch
without the file (a crash between the two writes, a rewritten batch) is counted when asked for.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from daybook.runtime import create_text, exists, read_text

FILE = "_counts.json"


@dataclass(frozen=True)
class Counts:
    """Totals of one or more batches; instants are microseconds, None where no row has one."""

    rows: int = 0
    bytes: int = 0
    oldest: int | None = None
    newest: int | None = None

    def __add__(self, other: Counts) -> Counts:
        low = [x for x in (self.oldest, other.oldest) if x is not None]
        high = [x for x in (self.newest, other.newest) if x is not None]
        return Counts(self.rows + other.rows, self.bytes + other.bytes, min(low, default=None), max(high, default=None))

    @property
    def newest_at(self) -> dt.datetime | None:
        return None if self.newest is None else dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=self.newest)

    @staticmethod
    def of(row: Row | dict) -> Counts:
        return Counts(row["rows"] or 0, row["bytes"] or 0, row["oldest"], row["newest"])


def measures(columns: list[str]) -> list[Column]:
    """What is counted: bytes from `size`; instants from `indexed_at`, else `mtime`."""
    at = next((F.unix_micros(c) for c in ("indexed_at", "mtime") if c in columns), F.lit(None).cast("long"))
    size = F.sum("size") if "size" in columns else F.lit(0).cast("long")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes"), F.min(at).alias("oldest"), F.max(at).alias("newest")]


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, *measures(df.columns)), seen


def keep(spark: SparkSession, folder: str, counts: Counts) -> None:
    create_text(spark, f"{folder}/{FILE}", json.dumps(vars(counts)))


def kept(spark: SparkSession, folder: str) -> Counts | None:
    path = f"{folder}/{FILE}"
    return Counts(**json.loads(read_text(spark, path))) if exists(spark, path) else None


def counted(df: DataFrame) -> Counts:
    return Counts.of(df.agg(*measures(df.columns)).first())
