"""Sources and sinks: the given tables are written as raw files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import register
from daybook.functions.keys import basename
from daybook.runtime import scratch
from daybook.schemas import PROC_SAMPLES, STATES
from daybook.sources import feeds, files, logs
from daybook.sources.raw import read_files, write_files


def _text_files(spark, sf):
    """One file per document: every 10th holds invalid bytes, every 4th CRLF line ends."""
    path = scratch(spark, "texts")
    text = F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    content = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(b"\xff\xfe"), F.encode(text, "UTF-8"))).otherwise(
        F.encode(text, "UTF-8")
    )
    write_files(X.docs(spark, sf).select(F.col("path").alias("name"), content.alias("content")), path)
    return path


@register(
    "read_texts",
    f"WITH {X.DOCS} SELECT path, window_id, epoch_us(ts) AS ts_us, text FROM docs WHERE doc_id % 10 <> 0",
)
def _(spark, sf):
    d = files.relative_names(files.read_texts(spark, _text_files(spark, sf)))
    return d.select("path", "window_id", X.us("ts").alias("ts_us"), "text")


@register("valid_utf8", f"WITH {X.DOCS} SELECT path, 'undecodable' AS reason FROM docs WHERE doc_id % 10 = 0")
def _(spark, sf):
    _, rejects = files.split_valid_utf8(read_files(spark, _text_files(spark, sf)))
    return rejects.select(basename(F.col("path")).alias("path"), "reason")


def _frame_dir(spark, sf):
    path = scratch(spark, "frames")
    name = F.concat(F.lit("w_"), F.col("page_id") % 9, F.lit("_"), F.lit(X.BASE) + F.col("page_id"), F.lit(".png"))
    write_files(
        X.texts(spark, sf, "pages").select(name.alias("name"), F.encode("html", "UTF-8").alias("content")), path
    )
    return path


@register(
    "read_captures",
    f"""SELECT 'w_' || (page_id % 9)::VARCHAR AS window_id, ({X.BASE} + page_id) * 1000000 AS ts_us, strlen(html) AS size,
    sha256(html) AS frame_hash FROM pages""",
)
def _(spark, sf):
    frames = files.read_captures(spark, _frame_dir(spark, sf))
    return frames.select("window_id", X.us("ts").alias("ts_us"), "size", "frame_hash")


@register(
    "file_inventory",
    f"""SELECT 'w_' || (page_id % 9)::VARCHAR || '_' || ({X.BASE} + page_id)::VARCHAR || '.png' AS path, strlen(html) AS size FROM pages""",
)
def _(spark, sf):
    return files.relative_names(files.file_inventory(spark, _frame_dir(spark, sf))).select("path", "size")


# Two documents of a source share each second.
SHARED = f"({X.BASE} + doc_id // 40)"


@register(
    "write_texts",
    f"""SELECT source || '_' || {SHARED}::VARCHAR || '.txt' AS path, source AS window_id, {SHARED} * 1000000 AS ts_us, text,
    strlen(text) AS size FROM documents QUALIFY row_number() OVER (PARTITION BY source, {SHARED} ORDER BY doc_id) = 1""",
)
def _(spark, sf):
    path = scratch(spark, "written")
    second = F.lit(X.BASE) + F.floor(F.col("doc_id") / 40)
    captured = X.texts(spark, sf, "documents").select(
        F.col("source").alias("window_id"),
        F.timestamp_micros(second * 1000000 + F.col("doc_id") % 40).alias("ts"),
        F.col("doc_id").alias("seq"),
        "text",
    )
    files.write_texts(captured, path)
    return spark.read.parquet(path).select("path", "window_id", X.us("ts").alias("ts_us"), "text", "size")


@register(
    "read_id_map",
    f"""WITH {X.DOCS} SELECT row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1 AS id, path FROM docs""",
)
def _(spark, sf):
    path = scratch(spark, "idmap")
    maps = X.docs(spark, sf).groupBy(F.floor(F.col("doc_id") / 500).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "path"))).alias("rows")
    )
    body = F.to_json(F.transform("rows", lambda r: r["path"]))
    name = F.concat(F.lit("map"), F.col("part").cast("string"), F.lit(".json"))
    write_files(maps.select(name.alias("name"), F.encode(body, "UTF-8").alias("content")), path)
    return files.read_id_map(spark, path)


@register(
    "read_logs",
    f"WITH {X.LOGS} SELECT line, epoch_us(ts) AS ts_us, logger, level, message FROM logs",
)
def _(spark, sf):
    path = scratch(spark, "logs")
    X.log_lines(spark, sf).select("line").write.text(path)
    parsed = logs.read_logs(spark, path)
    return parsed.select("line", X.us("ts").alias("ts_us"), "logger", "level", "message")


@register("read_states", f"WITH {X.STATES} SELECT session, epoch_us(ts) AS ts_us, seq, kind, active FROM states")
def _(spark, sf):
    path = scratch(spark, "states")
    X.states(spark, sf).write.parquet(path)
    return feeds.read_states(spark, path).select(*[X.us("ts").alias("ts_us") if f == "ts" else f for f in STATES.names])


@register(
    "read_proc_samples",
    f"WITH {X.SAMPLES} SELECT epoch_us(sample_ts) AS ts_us, pid, cmdline, cpu, rss, io_read, io_write FROM samples",
)
def _(spark, sf):
    path = scratch(spark, "samples")
    X.samples(spark, sf).write.parquet(path)
    cols = [X.us("sample_ts").alias("ts_us") if f == "sample_ts" else f for f in PROC_SAMPLES.names]
    return feeds.read_proc_samples(spark, path).select(*cols)
