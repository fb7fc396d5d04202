"""Status, sizes, logs, schedules and display values."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import register
from daybook.functions import display as D
from daybook.functions import schedule as SC
from daybook.operators import reports as RP
from daybook.operators import retention as R
from daybook.sources.logs import parse_logs


@register(
    "corpus_stats",
    f"""WITH {X.DOCS} SELECT count(*) AS n_docs, sum(size)::BIGINT AS total_bytes, round(sum(size) / 1048576.0, 2)::DOUBLE AS mib,
    format('{{:,}}', count(*)) AS count_text FROM docs""",
)
def _(spark, sf):
    stats = RP.corpus_stats(X.docs(spark, sf))
    return stats.select("n_docs", "total_bytes", D.mib(F.col("total_bytes")).alias("mib"), "count_text")


SIZED = f"""{X.DOCS}, {X.FRAMES}, files AS (SELECT 'texts' AS area, path, mtime, size FROM docs
  UNION ALL SELECT 'frames', path, mtime, size FROM frames)"""
AREAS = ["texts", "index", "frames"]


def _files(spark, sf):
    return R.files_of_areas({"texts": X.docs(spark, sf), "frames": X.frame_files(spark, sf)})


@register(
    "dir_sizes",
    f"""WITH {SIZED} SELECT a.area, coalesce(sum(size), 0)::BIGINT AS total_bytes, round(coalesce(sum(size), 0) / 1048576.0, 2)::DOUBLE AS mib
    FROM (SELECT unnest(['texts', 'index', 'frames']) AS area) a LEFT JOIN files USING (area) GROUP BY 1""",
)
def _(spark, sf):
    return RP.dir_sizes(_files(spark, sf), AREAS)


VSTATS = """vstats AS (SELECT count(*) AS processed, greatest((SELECT count(*) FROM docs) - count(*), 0) AS pending_reported,
  (SELECT count(*) FROM docs WHERE path NOT IN (SELECT path FROM vectors)) AS pending_exact, max(indexed_at) AS last_run FROM vectors)"""


@register(
    "vector_index_stats",
    f"WITH {X.VECTORS}, {VSTATS} SELECT TRUE AS enabled, processed, pending_reported, pending_exact, epoch_us(last_run) AS last_us FROM vstats",
)
def _(spark, sf):
    stats = RP.vector_index_stats(X.docs(spark, sf), X.vectors(spark, sf))
    return stats.select("enabled", "processed", "pending_reported", "pending_exact", X.us("last_run").alias("last_us"))


# The keyword index was last written when the middle document was captured.
INDEX_FILES = "index_files AS (SELECT mtime FROM docs WHERE doc_id <= (SELECT max(doc_id) // 2 FROM docs))"
KSTATS = """kstats AS (SELECT count(*) - count_if(mtime > latest)::BIGINT AS processed, count_if(mtime > latest)::BIGINT AS pending, max(latest) AS last_run
  FROM docs, (SELECT max(mtime) AS latest FROM index_files))"""


def _index_files(spark, sf):
    d = X.docs(spark, sf)
    middle = d.agg(F.floor(F.max("doc_id") / 2)).scalar()
    return d.filter(F.col("doc_id") <= middle).select("path", "mtime")


@register(
    "keyword_index_stats",
    f"WITH {X.DOCS}, {INDEX_FILES}, {KSTATS} SELECT TRUE AS enabled, processed, pending AS pending_reported, epoch_us(last_run) AS last_us FROM kstats",
)
def _(spark, sf):
    stats = RP.keyword_index_stats(X.docs(spark, sf), _index_files(spark, sf))
    return stats.select("enabled", "processed", "pending_reported", X.us("last_run").alias("last_us"))


CHOSEN = "chosen AS (SELECT * FROM samples WHERE contains(cmdline, 'click') OR contains(cmdline, 'sign'))"
USED = """round(sum(cpu), 1) AS cpu_pct, round(sum(rss) / 1048576.0, 1)::DOUBLE AS mem_mib,
  round(sum(io_read) / 1024.0, 1)::DOUBLE AS read_kib, round(sum(io_write) / 1024.0, 1)::DOUBLE AS write_kib"""


@register("engine_processes", f"WITH {X.SAMPLES}, {CHOSEN} SELECT epoch_us(sample_ts) AS ts_us, pid, cmdline, rss FROM chosen")
def _(spark, sf):
    rows = RP.engine_processes(X.samples(spark, sf), X.NEEDLES)
    return rows.select(X.us("sample_ts").alias("ts_us"), "pid", "cmdline", "rss")


@register("resource_totals", f"WITH {X.SAMPLES}, {CHOSEN} SELECT epoch_us(sample_ts) AS ts_us, {USED} FROM chosen GROUP BY 1")
def _(spark, sf):
    rows = RP.resource_totals(X.samples(spark, sf), X.NEEDLES)
    return rows.select(X.us("sample_ts").alias("ts_us"), "cpu_pct", "mem_mib", "read_kib", "write_kib")


STATUS = (
    f"""WITH {X.VECTORS}, {INDEX_FILES}, {X.SAMPLES}, {CHOSEN}, {VSTATS}, {KSTATS}, used AS (SELECT {USED} FROM chosen)
    SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT round(sum(size) / 1048576.0, 2)::DOUBLE FROM docs) AS db_mib,
    k.processed::VARCHAR AS keyword_processed, k.pending::VARCHAR AS keyword_pending, strftime(k.last_run, '%H:%M:%S') AS keyword_last_run,
    v.processed::VARCHAR AS vector_processed, v.pending_reported::VARCHAR AS vector_pending, strftime(v.last_run, '%H:%M:%S') AS vector_last_run,
    used.*, '~ 12:45' AS next_update, '2024-02-11 12:45:00' AS next_run FROM vstats v, kstats k, used"""
)


@register("archive_status", STATUS)
def _(spark, sf):
    now = F.lit(X.NOW).cast("timestamp")
    return RP.archive_status(
        X.docs(spark, sf), X.vectors(spark, sf), _index_files(spark, sf), X.samples(spark, sf), X.NEEDLES, now
    )


@register("archive_status_stored", STATUS)
def _(spark, sf):
    """From the counters of a store that was filled in four batches of texts."""
    return RP.stored_status(X.counted_archive(spark, sf), X.samples(spark, sf), X.NEEDLES, F.lit(X.NOW).cast("timestamp"))


RAN = f"logs_marked AS (SELECT line_no, line FROM logs WHERE {' AND '.join(f'contains(line, {m!r})' for m in X.MARKERS)})"
LAST_RUN = "coalesce((SELECT trim(split_part(line, ',', 1)) FROM logs_marked ORDER BY line_no DESC LIMIT 1), 'Pending')"


@register(
    "archive_health",
    f"""WITH {X.VECTORS}, {X.FRAMES}, {X.LOGS}, {RAN}, {VSTATS} SELECT processed AS items, pending_reported AS unprocessed, {LAST_RUN} AS last_run,
    (SELECT round(sum(size) / 1048576.0, 2)::DOUBLE FROM docs) AS texts_mib, 0.0::DOUBLE AS index_mib,
    (SELECT round(sum(size) / 1048576.0, 2)::DOUBLE FROM frames) AS frames_mib FROM vstats""",
)
def _(spark, sf):
    return RP.archive_health(
        X.docs(spark, sf), X.vectors(spark, sf), X.log_lines(spark, sf), X.MARKERS, _files(spark, sf), AREAS
    )


@register(
    "recent_captures",
    f"""WITH {X.FRAMES} SELECT path, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS modified, round(size / 1024.0, 1)::DOUBLE AS size_kib
    FROM frames ORDER BY mtime DESC, path LIMIT 10""",
)
def _(spark, sf):
    return RP.recent_captures(X.frame_files(spark, sf))


@register("log_tail", f"WITH {X.LOGS} SELECT line_no, line FROM log_lines ORDER BY line_no DESC LIMIT 200")
def _(spark, sf):
    return RP.log_tail(X.log_lines(spark, sf))


@register("log_contains_all", f"WITH {X.LOGS}, {RAN} SELECT line_no, line FROM logs_marked")
def _(spark, sf):
    return RP.log_contains_all(X.log_lines(spark, sf), X.MARKERS)


@register("last_successful_run", f"WITH {X.LOGS}, {RAN} SELECT {LAST_RUN} AS last_run")
def _(spark, sf):
    return RP.last_successful_run(X.log_lines(spark, sf), X.MARKERS)


@register(
    "cycle_history",
    rf"""WITH {X.LOGS}, m AS (SELECT CAST(ts AS DATE)::VARCHAR AS day,
      regexp_extract(message, 'Added (\d+) non-empty files \(out of (\d+) discovered\) in ([0-9.]+) seconds', ['a', 'd', 's']) AS c,
      nullif(regexp_extract(message, 'Flushed batch of (\d+) files', 1), '')::BIGINT AS f FROM logs
      WHERE contains(message, 'Added ') OR contains(message, 'Flushed batch'))
    SELECT day, count(nullif(c.a, '')) AS cycles, coalesce(sum(nullif(c.a, '')::BIGINT), 0)::BIGINT AS added,
    coalesce(sum(nullif(c.d, '')::BIGINT), 0)::BIGINT AS discovered, round(coalesce(sum(nullif(c.s, '')::DOUBLE), 0), 1) AS seconds,
    count(f) AS flushes, coalesce(sum(f), 0)::BIGINT AS flushed FROM m GROUP BY day""",
)
def _(spark, sf):
    history = RP.cycle_history(parse_logs(X.log_lines(spark, sf)))
    return history.withColumn("day", F.col("day").cast("string"))


@register("next_quarter_hour", "SELECT event_id, ((epoch_us(ts) // 900000000) + 1) * 900000000 AS next_us FROM events")
def _(spark, sf):
    return X.events(spark, sf).select("event_id", X.us(SC.next_quarter_hour(F.col("ts"))).alias("next_us"))


SLOTS = """SELECT event_id, epoch_us(date_trunc('hour', ts) + to_minutes(coalesce(
    list_filter(range(base, 60, step), lambda m: m > minute(ts))[1], base + 60))) AS next_us FROM
    (SELECT event_id, ts, CASE event_id % 4 WHEN 1 THEN 5 ELSE 0 END AS base, CASE event_id % 4 WHEN 0 THEN 15 ELSE 20 END AS step
     FROM events WHERE event_id % 4 < 2)
    UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 >= 2"""


@register("next_slot", SLOTS)
def _(spark, sf):
    n = F.col("event_id") % 4
    plan = F.when(n == 0, F.lit("*:0/15")).when(n == 1, F.lit("*:5/20")).when(n == 2, F.lit("*:0/0")).otherwise(F.lit("bad"))
    return X.events(spark, sf).select("event_id", X.us(SC.next_slot(F.col("ts"), plan)).alias("next_us"))


@register(
    "backlog_band",
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Disabled' WHEN n_chars % 100 = 0 THEN 'low' WHEN n_chars % 100 < 50 THEN 'mid' ELSE 'high' END AS band
    FROM documents""",
)
def _(spark, sf):
    raw = F.when(F.col("doc_id") % 11 == 0, F.lit("Disabled")).otherwise((F.col("n_chars") % 100).cast("string"))
    return X.table(spark, sf, "documents").select("doc_id", D.backlog_band(raw).alias("band"))


def _documents(spark, sf):
    return X.table(spark, sf, "documents")


@register("fmt_mib", "SELECT doc_id, round(n_chars * 4096 / 1048576.0, 2)::DOUBLE AS mib FROM documents")
def _(spark, sf):
    shown = D.fmt_mib(F.col("n_chars") * 4096)
    return _documents(spark, sf).select("doc_id", F.replace(shown, F.lit(" MB")).cast("double").alias("mib"))


@register("fmt_kib", "SELECT doc_id, round(n_chars / 1024.0, 1)::DOUBLE AS kib FROM documents")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", D.fmt_kib(F.col("n_chars")).cast("double").alias("kib"))


@register("fmt_thousands", "SELECT doc_id, format('{:,}', n_chars * 37) AS shown FROM documents")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", D.fmt_thousands(F.col("n_chars") * 37).alias("shown"))


@register("fmt_time", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'N/A' ELSE strftime(ts, '%H:%M:%S') END AS shown FROM events")
def _(spark, sf):
    ts = F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    return X.events(spark, sf).select("event_id", D.fmt_time(ts).alias("shown"))


@register("fmt_instant", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS instant, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def _(spark, sf):
    ts = F.col("ts")
    return X.events(spark, sf).select("event_id", D.fmt_instant(ts).alias("instant"), D.stamp(ts).alias("stamp"))


@register("progress_pct", "SELECT doc_id, round(100.0::DOUBLE * doc_id / n_chars, 1) AS pct FROM documents")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", D.progress_pct(F.col("doc_id"), F.col("n_chars")).alias("pct"))


@register("clamp0", "SELECT doc_id, greatest(doc_id - 100, 0) AS n FROM documents")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", D.clamp0(F.col("doc_id") - 100).alias("n"))
