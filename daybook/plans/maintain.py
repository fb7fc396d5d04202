"""Maintenance: retention, reconciliation, resets, rebuilds, snapshots. All take `dry_run`."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import retention as R
from daybook.operators.embed import Encoder
from daybook.plans.cycle import CycleReport, run_cycle
from daybook.schemas import stored
from daybook.sources.store import ArchiveStore

AREAS = ("frames", "texts")
INDEX_TABLES = ("vectors", "skipped")
SNAPSHOT_TABLES = ("vectors", "postings", "doc_stats", "skipped")


def _candidates(store: ArchiveStore, areas: tuple[str, ...], last_day: dt.date) -> DataFrame:
    """Files of the areas up to a day; the day filter prunes directories. Days are those of the
    writing session, so one more is read."""
    last = F.lit(last_day + dt.timedelta(days=1))
    return R.files_of_areas({a: store.read(a).filter(F.col("day") <= last) for a in areas})


def apply_retention(
    store: ArchiveStore, now: dt.datetime, days: float, dry_run: bool = False, areas: tuple[str, ...] = AREAS
) -> DataFrame:
    """Delete files older than `days` days; returns count and sample names either way.

    Only the metadata of directories up to the cutoff day is read and no row is rewritten: the
    new cutoff is committed, readers prune by it, and whole expired days are removed.
    """
    return _retain(store, R.cutoff_of(now, days), dry_run, areas)


def _retain(store: ArchiveStore, cutoff: dt.datetime, dry_run: bool, areas: tuple[str, ...]) -> DataFrame:
    doomed = R.expired(_candidates(store, areas, cutoff.date()), cutoff, 0)
    report = store.spark.createDataFrame(R.sample_for_dry_run(doomed).collect(), "n_files long, sample array<string>, n_more long")
    if not dry_run:
        for a in areas:
            head = store.head(a)
            if head is not None and (head.cutoff is None or head.cutoff_at < cutoff):
                store.retain(a, cutoff)
                store.vacuum(a)
    return report


def retain_then_reset(
    store: ArchiveStore, now: dt.datetime, days: int, dry_run: bool = False, areas: tuple[str, ...] = AREAS
) -> DataFrame:
    """Second policy in one run: age in whole days above `days`, then an empty vector index."""
    first_kept = R.cutoff_of(now, days + 1) + dt.timedelta(microseconds=1)
    report = _retain(store, first_kept, dry_run, areas)
    reset_vector_index(store, dry_run)
    return report


def reset_vector_index(store: ArchiveStore, dry_run: bool = False) -> list[str]:
    """Empty the vector index, so that the next cycle embeds everything; returns the tables hit."""
    present = [t for t in INDEX_TABLES if store.head(t) is not None]
    if not dry_run:
        for t in present:
            store.reset(t)
    return present


clear_index = reset_vector_index


def full_rebuild(store: ArchiveStore, docs: DataFrame, encoder: Encoder, dry_run: bool = False, **limits) -> CycleReport:
    """Reset, then one cycle over everything."""
    reset_vector_index(store, dry_run)
    return run_cycle(store, docs, encoder, dry_run=dry_run, **limits)


def _rewrite_without(store: ArchiveStore, doomed: DataFrame, kept: DataFrame) -> None:
    """Rewrite only the batches that hold doomed vectors. Batch numbers are few and come to the driver."""
    batches = [r.batch for r in doomed.select("batch").distinct().collect()]
    if batches:
        store.rewrite_batches("vectors", batches, kept.filter(F.col("batch").isin(batches)))


def reconcile_index(store: ArchiveStore, docs: DataFrame, dry_run: bool = False) -> DataFrame:
    """Remove vectors without a document, without re-embedding; returns the count removed."""
    vectors = store.read("vectors")
    orphans = R.orphan_vectors(vectors, docs)
    n = orphans.count()
    if n and not dry_run:
        _rewrite_without(store, orphans, R.without_orphans(vectors, docs))
    return store.spark.range(1).select(F.lit(n).cast("long").alias("n_orphans"))


def delete_latest_vector(store: ArchiveStore, dry_run: bool = False) -> DataFrame:
    """Remove the newest vector record (greatest id); returns the removed row's key."""
    vectors = store.read("vectors")
    last = R.latest_record(vectors, "id")
    keys = store.spark.createDataFrame(last.select("id", "path").collect(), "id long, path string")
    if not dry_run:
        _rewrite_without(store, last, R.delete_latest(vectors, "id"))
    return keys


# -- snapshots ---------------------------------------------------------------------------------


def export_snapshot(store: ArchiveStore, dest: str, now: dt.datetime, tables: tuple[str, ...] = SNAPSHOT_TABLES) -> str:
    """Copy the index tables and a manifest of row counts to `dest/snapshot=<stamp>`."""
    target = f"{dest}/snapshot={now:%Y%m%d_%H%M%S}"
    spark = store.spark
    counts = []
    for t in tables:
        store.read(t).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/{t}")
        counts.append((t, spark.read.schema(stored(t)).parquet(f"{target}/{t}").count()))
    spark.createDataFrame(counts, "table string, n_rows long").coalesce(1).write.mode("overwrite").json(
        f"{target}/manifest"
    )
    return target


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of a snapshot, or None where there is none. Counts and columns must match."""
    try:
        manifest = spark.read.schema("table string, n_rows long").json(f"{path}/manifest").collect()
    except AnalysisException:
        return None
    out = {}
    for row in manifest:
        want = stored(row.table)
        found = spark.read.parquet(f"{path}/{row.table}")
        if set(found.columns) != set(want.fieldNames()):
            raise ValueError(f"snapshot table {row.table} has columns {found.columns}")
        if found.count() != row.n_rows:
            raise ValueError(f"snapshot table {row.table} does not hold the {row.n_rows} rows of its manifest")
        out[row.table] = found
    return out


def import_snapshot(store: ArchiveStore, path: str, dry_run: bool = False) -> bool:
    """Replace the index by a snapshot. The previous directories stay as the backup."""
    tables = read_snapshot(store.spark, path)
    if tables is None:
        return False
    if not dry_run:
        for name, rows in tables.items():
            store.replace(name, rows, "import")
    return True
