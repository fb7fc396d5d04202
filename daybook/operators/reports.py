"""Counts, sizes and recent activity. Every report is a one-row or at most k-row aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions import display as D
from daybook.functions.keys import before_first_comma
from daybook.functions.schedule import fmt_quarter_hour, next_slot
from daybook.operators.backlog import pending_docs
from daybook.sources.store import ArchiveStore

DISABLED = "Disabled"


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Number of texts and their bytes, plus both as shown."""
    totals = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
    return totals.select(
        "*", D.fmt_mib(F.col("total_bytes")).alias("size_text"), D.fmt_thousands(F.col("n_docs")).alias("count_text")
    )


def dir_sizes(files: DataFrame, areas: list[str]) -> DataFrame:
    """Bytes and MiB per area, 0 for an area without files. `files` has (area, size)."""
    sums = files.groupBy("area").agg(F.sum("size").alias("_b"))
    names = files.sparkSession.createDataFrame([(a,) for a in areas], "area string")
    size = F.coalesce("_b", F.lit(0))
    return names.join(sums, "area", "left").select(
        "area", size.alias("total_bytes"), D.mib(size).alias("mib")
    )


def vector_index_stats(docs: DataFrame, vectors: DataFrame, enabled: bool = True) -> DataFrame:
    """Processed and pending counts of the vector index and its last run.

    `pending_reported` is the clamped difference of the counts, `pending_exact` counts the
    documents without a vector.
    """
    if not enabled:
        return _disabled(docs, ["processed", "pending_reported", "pending_exact"])
    total = docs.agg(F.count(F.lit(1))).scalar()
    exact = pending_docs(docs.select("path"), vectors).agg(F.count(F.lit(1))).scalar()
    return vectors.agg(F.count(F.lit(1)).alias("processed"), F.max("indexed_at").alias("last_run")).select(
        F.lit(True).alias("enabled"),
        "processed",
        D.clamp0(total - F.col("processed")).alias("pending_reported"),
        exact.alias("pending_exact"),
        "last_run",
    )


def keyword_index_stats(docs: DataFrame, index_files: DataFrame, enabled: bool = True) -> DataFrame:
    """Counts by modification time: pending documents are newer than the newest index file."""
    if not enabled:
        return _disabled(docs, ["processed", "pending_reported"])
    latest = index_files.agg(F.max("mtime")).scalar()
    newer = F.count_if(latest.isNull() | (F.col("mtime") > latest))
    counts = docs.agg(F.count(F.lit(1)).alias("_n"), newer.alias("_p"))
    return counts.select(
        F.lit(True).alias("enabled"),
        D.clamp0(F.col("_n") - F.col("_p")).alias("processed"),
        F.col("_p").alias("pending_reported"),
        latest.alias("last_run"),
    )


def _disabled(df: DataFrame, counts: list[str]) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.lit(False).alias("enabled"),
        *[F.lit(None).cast("long").alias(c) for c in counts],
        F.lit(None).cast("timestamp").alias("last_run"),
    )


def shown_count(enabled: Column, n: Column) -> Column:
    """A count as the status shows it."""
    return F.when(enabled, n.cast("string")).otherwise(F.lit(DISABLED))


def engine_processes(samples: DataFrame, needles: list[str]) -> DataFrame:
    """Samples whose command line contains any of the texts (case-sensitive)."""
    return samples.filter(reduce(lambda a, b: a | b, [F.col("cmdline").contains(n) for n in needles]))


def resource_totals(samples: DataFrame, needles: list[str]) -> DataFrame:
    """Summed CPU, memory and I/O of the selected processes per sampling instant."""
    sums = engine_processes(samples, needles).groupBy("sample_ts").agg(
        F.sum("cpu").alias("_cpu"), F.sum("rss").alias("_rss"), F.sum("io_read").alias("_r"), F.sum("io_write").alias("_w")
    )
    return sums.select(
        "sample_ts",
        F.round("_cpu", 1).alias("cpu_pct"),
        D.mib(F.col("_rss"), 1).alias("mem_mib"),
        D.kib(F.col("_r")).alias("read_kib"),
        D.kib(F.col("_w")).alias("write_kib"),
    )


def recent_captures(files: DataFrame, n: int = 10) -> DataFrame:
    """The newest files with their time to the second and size in KiB."""
    newest = files.orderBy(F.col("mtime").desc(), "path").limit(n)
    return newest.select("path", D.fmt_instant(F.col("mtime")).alias("modified"), D.kib(F.col("size")).alias("size_kib"))


def log_contains_all(logs: DataFrame, texts: list[str], line: str = "line") -> DataFrame:
    return logs.filter(reduce(lambda a, b: a & b, [F.col(line).contains(t) for t in texts]))


def log_tail(logs: DataFrame, n: int = 200) -> DataFrame:
    """The last `n` lines in file order."""
    return logs.orderBy(F.col("line_no").desc()).limit(n).orderBy("line_no")


def last_successful_run(logs: DataFrame, markers: list[str]) -> DataFrame:
    """Timestamp text of the last line that holds all markers, else `Pending`."""
    last = log_contains_all(logs, markers).agg(F.max_by(before_first_comma(F.col("line")), "line_no").alias("t"))
    return last.select(F.coalesce("t", F.lit("Pending")).alias("last_run"))


# How a cycle writes its result to the log.
CYCLE_LINE = r"Added (\d+) (?:non-empty )?files(?: \(out of (\d+) discovered\))? in ([0-9.]+) seconds"
FLUSH_LINE = r"Flushed batch of (\d+) files"


def cycle_history(logs: DataFrame) -> DataFrame:
    """Cycles, documents and seconds per day, recovered from parsed log messages."""
    take = lambda rx, i: F.nullif(F.regexp_extract("message", rx, i), F.lit(""))
    added = take(CYCLE_LINE, 1).cast("long")
    rows = logs.filter(F.col("message").rlike(f"{CYCLE_LINE}|{FLUSH_LINE}")).select(
        F.to_date("ts").alias("day"),
        added.alias("added"),
        F.coalesce(take(CYCLE_LINE, 2).cast("long"), added).alias("discovered"),
        take(CYCLE_LINE, 3).cast("double").alias("seconds"),
        take(FLUSH_LINE, 1).cast("long").alias("flushed"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("day").agg(
        F.count("added").alias("cycles"),
        zero("added").alias("added"),
        zero("discovered").alias("discovered"),
        F.round(zero("seconds"), 1).alias("seconds"),
        F.count("flushed").alias("flushes"),
        zero("flushed").alias("flushed"),
    )


def _one_row(df: DataFrame) -> Column:
    """A one-row report as a scalar struct, so that reports combine without a join."""
    return df.select(F.struct("*")).scalar()


def archive_health(docs: DataFrame, vectors: DataFrame, logs: DataFrame, markers: list[str], files: DataFrame, areas: list[str]) -> DataFrame:
    """Index counts, last successful run, and MiB of each area, in one row."""
    index = _one_row(vector_index_stats(docs, vectors))
    run = last_successful_run(logs, markers).scalar()
    sizes = files.groupBy().agg(
        *[F.round(F.coalesce(F.sum(F.when(F.col("area") == a, F.col("size"))), F.lit(0)) / F.lit(D.MIB), 2).alias(f"{a}_mib") for a in areas]
    )
    return sizes.select(
        index["processed"].alias("items"), index["pending_reported"].alias("unprocessed"), run.alias("last_run"), "*"
    )


def _status(
    totals: DataFrame, samples: DataFrame, needles: list[str], now: Column, keyword_enabled: bool, vector_enabled: bool, schedule: str
) -> DataFrame:
    """The status row from totals: n_docs, total_bytes, newer, keyword_last, n_vectors, vector_last."""
    used = engine_processes(samples, needles).agg(
        F.struct(
            F.round(F.sum("cpu"), 1).alias("cpu_pct"),
            D.mib(F.sum("rss"), 1).alias("mem_mib"),
            D.kib(F.sum("io_read")).alias("read_kib"),
            D.kib(F.sum("io_write")).alias("write_kib"),
        )
    ).scalar()
    keyword, vector = F.lit(keyword_enabled), F.lit(vector_enabled)
    return totals.select(
        "n_docs",
        D.mib(F.col("total_bytes")).alias("db_mib"),
        shown_count(keyword, D.clamp0(F.col("n_docs") - F.col("newer"))).alias("keyword_processed"),
        shown_count(keyword, F.col("newer")).alias("keyword_pending"),
        D.fmt_time(F.when(keyword, F.col("keyword_last"))).alias("keyword_last_run"),
        shown_count(vector, F.col("n_vectors")).alias("vector_processed"),
        shown_count(vector, D.clamp0(F.col("n_docs") - F.col("n_vectors"))).alias("vector_pending"),
        D.fmt_time(F.when(vector, F.col("vector_last"))).alias("vector_last_run"),
        used["cpu_pct"].alias("cpu_pct"),
        used["mem_mib"].alias("mem_mib"),
        used["read_kib"].alias("read_kib"),
        used["write_kib"].alias("write_kib"),
        fmt_quarter_hour(now).alias("next_update"),
        D.fmt_instant(next_slot(now, F.lit(schedule))).alias("next_run"),
    )


def archive_status(
    docs: DataFrame, vectors: DataFrame, index_files: DataFrame, samples: DataFrame, needles: list[str], now: Column,
    keyword_enabled: bool = True, vector_enabled: bool = True, schedule: str = "*:0/15",
) -> DataFrame:
    """Everything the status page shows, in one typed row; each table is scanned once."""
    latest = index_files.agg(F.max("mtime")).scalar()
    v = vectors.agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("indexed_at").alias("last"))).scalar()
    totals = docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.count_if(latest.isNull() | (F.col("mtime") > latest)).alias("newer"),
    ).select("*", latest.alias("keyword_last"), v["n"].alias("n_vectors"), v["last"].alias("vector_last"))
    return _status(totals, samples, needles, now, keyword_enabled, vector_enabled, schedule)


def stored_status(
    store: ArchiveStore, samples: DataFrame, needles: list[str], now: Column, keyword_enabled: bool = True, vector_enabled: bool = True, schedule: str = "*:0/15"
) -> DataFrame:
    """The same row from the counters of a store's batches: `texts`, the keyword index (`doc_stats`) and `vectors` are not scanned.

    Of the texts only batches that hold both older and newer ones than the last keyword run are looked into.
    """
    docs, vectors, latest = store.counts("texts"), store.counts("vectors"), store.counts("doc_stats").newest_at
    newer = docs if latest is None else store.counts("texts", above=latest)
    totals = store.spark.range(1).select(
        F.lit(docs.rows).cast("long").alias("n_docs"),
        F.lit(docs.bytes).cast("long").alias("total_bytes"),
        F.lit(newer.rows).cast("long").alias("newer"),
        F.lit(latest).cast("timestamp").alias("keyword_last"),
        F.lit(vectors.rows).cast("long").alias("n_vectors"),
        F.lit(vectors.newest_at).cast("timestamp").alias("vector_last"),
    )
    return _status(totals, samples, needles, now, keyword_enabled, vector_enabled, schedule)
