"""Which documents still need work, in which order, under which id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.text import is_non_blank
from daybook.runtime import durable

TOP_K_ROWS = 100_000
BATCH_DOCS = 64


def pending_docs(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents whose path is not indexed (set difference that keeps the columns)."""
    return docs.join(indexed.select("path"), "path", "left_anti")


def of_their_days(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """The documents of the capture days on which any of `paths` lies, if documents are stored by `day`; else all of them.

    Days are few (one per calendar day), so they become a partition filter and other days' files are not opened.
    """
    if "day" not in docs.columns:
        return docs
    days = docs.select("path", "day").join(paths.select("path"), "path", "left_semi").select("day").distinct()
    return docs.filter(F.col("day").isin([r.day for r in days.collect()]))


def except_paths(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Set difference of the bare paths."""
    return docs.select("path").subtract(indexed.select("path"))


def changed_docs(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """New documents and those modified after they were indexed."""
    known = stats.select("path", F.col("mtime").alias("_seen"))
    new = F.col("_seen").isNull()
    return docs.join(known, "path", "left").filter(new | (F.col("mtime") > F.col("_seen"))).drop("_seen")


def removed_docs(stats: DataFrame, docs: DataFrame) -> DataFrame:
    """Indexed paths that no longer exist."""
    return stats.join(docs.select("path"), "path", "left_anti")


def non_blank(docs: DataFrame) -> DataFrame:
    return docs.filter(is_non_blank(F.col("text")))


def ranked_paths(paths: DataFrame) -> DataFrame:
    """(path, position): dense positions 0..n-1 in path order, without a global window.

    Paths are range-partitioned and sorted within partitions; the frame is checkpointed, so
    that positions and partition sizes come from the same rows.
    """
    ordered = durable(
        paths.select("path")
        .repartitionByRange("path")
        .sortWithinPartitions("path")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return ordered.join(F.broadcast(starts), "_part").select(
        "path", (F.col("_start") + F.col("_at")).alias("position")
    )


def capped_pending(pending: DataFrame, cap: int = 0) -> DataFrame:
    """The first `cap` pending documents in path order; 0 means all.

    Only paths are ordered. Small caps use Spark's top-k, large ones a distributed ranking.
    """
    if cap <= 0:
        return pending
    if cap <= TOP_K_ROWS:
        chosen = pending.select("path").orderBy("path").limit(cap)
    else:
        chosen = ranked_paths(pending).filter(F.col("position") < cap).select("path")
    return pending.join(chosen, "path", "left_semi")


def assign_ids(docs: DataFrame, start: int = 0) -> DataFrame:
    """Add dense ids that continue from `start`, in path order."""
    ids = ranked_paths(docs).select("path", (F.col("position") + F.lit(start)).alias("id"))
    return ids if docs.columns == ["path"] else docs.join(ids, "path")


def pack_batches(numbered: DataFrame, start: int = 0, size: int = BATCH_DOCS) -> DataFrame:
    """Add `batch_no`: groups of `size` documents in id order, the last one partial."""
    return numbered.withColumn("batch_no", F.floor((F.col("id") - F.lit(start)) / F.lit(size)))
