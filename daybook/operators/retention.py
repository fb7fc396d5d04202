"""Age rules and what they leave behind in the vector index."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.keys import basename, of_type

DAY = 86_400


def as_utc(instant: dt.datetime) -> dt.datetime:
    """Instants without a zone are UTC."""
    return instant if instant.tzinfo else instant.replace(tzinfo=dt.timezone.utc)


def cutoff_of(now: dt.datetime, days: float) -> dt.datetime:
    return as_utc(now) - dt.timedelta(days=days)


def _instant(value: dt.datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(as_utc(value)).cast("timestamp")


def expired(files: DataFrame, now: dt.datetime, days: float) -> DataFrame:
    """Files strictly older than `days` days of 86,400 seconds."""
    return files.filter(F.col("mtime") < _instant(cutoff_of(now, days)))


def expired_whole_days(files: DataFrame, now: dt.datetime, days: int, kinds: tuple[str, ...] = ("txt", "png")) -> DataFrame:
    """Second rule: age in whole days greater than `days`, for the given extensions only."""
    age = (F.unix_micros(_instant(now)) - F.unix_micros("mtime")) / F.lit(1_000_000 * DAY)
    kind = of_type(F.col("path"), kinds[0])
    for k in kinds[1:]:
        kind = kind | of_type(F.col("path"), k)
    return files.filter(kind & (F.floor(age) > days))


def files_of_areas(areas: dict[str, DataFrame]) -> DataFrame:
    """Files of several directories in one table with an `area` column."""
    out = None
    for name, files in areas.items():
        part = files.select(F.lit(name).alias("area"), "path", "mtime", "size")
        out = part if out is None else out.unionByName(part)
    return out


def sample_for_dry_run(files: DataFrame, n: int = 5) -> DataFrame:
    """One row: how many files, the first `n` names in path order, and how many more."""
    first = files.select("path").orderBy("path").limit(n)
    names = first.agg(F.array_sort(F.collect_list("path")).alias("p")).select(
        F.transform("p", lambda p: basename(p))
    ).scalar()
    total = files.agg(F.count(F.lit(1)).alias("n_files"))
    return total.select("n_files", names.alias("sample"), F.greatest(F.col("n_files") - n, F.lit(0)).alias("n_more"))


def orphan_vectors(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors whose document no longer exists."""
    return vectors.join(docs.select("path"), "path", "left_anti")


def without_orphans(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    return vectors.join(docs.select("path"), "path", "left_semi")


def latest_record(records: DataFrame, ts: str = "ts") -> DataFrame:
    """The records with the greatest instant (all of them on a tie)."""
    newest = records.agg(F.max(ts)).scalar()
    return records.filter(F.col(ts) == newest)


def delete_latest(records: DataFrame, ts: str = "ts") -> DataFrame:
    """Everything but the latest record."""
    newest = records.agg(F.max(ts)).scalar()
    return records.filter(F.col(ts) < newest)
