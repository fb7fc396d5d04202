"""Streaming twins: events arrive as files in time order and drain into a Parquet sink."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.captures import ASOF, FIRST, GATED, UNCHANGED, throttle_sql
from catalog.registry import register
from daybook.operators.embed import default_encoder
from daybook.operators.extract import extract_html
from daybook.operators.postings import live_postings
from daybook.plans.search import KEYWORD
from daybook.runtime import scratch
from daybook.sources.feeds import stream_table
from daybook.sources.store import ArchiveStore
from daybook.streaming import captures as ST
from daybook.streaming import ingest as SI
from daybook.streaming.index import index_stream

CHUNKS = 4
FILES = 2


@contextmanager
def _state_partitions(spark):
    """Streaming state gets one partition per core; a stream keeps this number for its life."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _inbox(spark, rows, span):
    """Write rows as CHUNKS groups of files in time order; `span` is (first, last) microsecond."""
    path = scratch(spark, "inbox")
    width = (span[1] - span[0]) // CHUNKS + 1
    chunk = F.floor((X.us("ts") - F.lit(span[0])) / F.lit(width))
    for i in range(CHUNKS):
        rows.filter(chunk == i).repartition(FILES).write.mode("append").parquet(path)
    return stream_table(spark, path, rows.schema, files_per_trigger=FILES)


def _span(spark, sf):
    return tuple(X.events(spark, sf).agg(F.min(X.us("ts")), F.max(X.us("ts"))).first())


def _drain(spark, stream):
    path = scratch(spark, "sink")
    ST.ingest(stream, path, scratch(spark, "checkpoint")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@register("drop_unchanged_stream", UNCHANGED)
def _(spark, sf):
    with _state_partitions(spark):
        arriving = _inbox(spark, X.captures(spark, sf), _span(spark, sf))
        return _drain(spark, ST.drop_unchanged_stream(arriving)).filter("NOT late").select("seq", "window_id")


@register("gate_stream", GATED)
def _(spark, sf):
    with _state_partitions(spark):
        span = _span(spark, sf)
        arriving = _inbox(spark, X.captures(spark, sf), span), _inbox(spark, X.states(spark, sf), span)
        return _drain(spark, ST.gate_stream(*arriving)).filter("NOT late").select("seq")


@register("throttle_stream", throttle_sql("event_type", 3600))
def _(spark, sf):
    with _state_partitions(spark):
        rows = X.captures(spark, sf).select("seq", "ts", F.col("title").alias("k"))
        return _drain(spark, ST.throttle_stream(_inbox(spark, rows, _span(spark, sf)), ["k"], 3600)).filter("NOT late").select("seq", "k")


INGESTED = f"""{ASOF}, firsts AS (SELECT * FROM captures JOIN suspends USING (seq) JOIN locks USING (seq)
  WHERE NOT coalesce(suspend_active, FALSE) AND NOT coalesce(lock_active, FALSE) AND NOT contains(title, 'err')
  QUALIFY row_number() OVER (PARTITION BY window_id, floor(epoch(ts)) ORDER BY ts, seq) = 1),
seen AS (SELECT *, lag(frame_hash) OVER w AS prev, row_number() OVER w AS n FROM firsts WINDOW w AS (PARTITION BY window_id ORDER BY ts, seq))
SELECT seq, window_id FROM seen WHERE n = 1 OR frame_hash IS DISTINCT FROM prev"""


@register("frame_streams", INGESTED)
def _(spark, sf):
    with _state_partitions(spark):
        span, root = _span(spark, sf), scratch(spark, "ingest")
        arriving = _inbox(spark, X.captures(spark, sf), span), _inbox(spark, X.states(spark, sf), span)
        for stream in ST.frame_streams(*arriving, root, "ERR"):
            stream.start().awaitTermination()
        return spark.read.parquet(f"{root}/kept").filter("NOT late").select("seq", "window_id")


TEXTS = f"""{INGESTED.rpartition("SELECT seq, window_id")[0]}SELECT window_id || '_' || floor(epoch(ts))::BIGINT || '.txt' AS path,
  event_type || chr(10) || 'event ' || seq || ' of ' || window_id AS text FROM seen JOIN (SELECT event_id AS seq, event_type FROM events) USING (seq)
  WHERE n = 1 OR frame_hash IS DISTINCT FROM prev"""


def _ingested(spark, sf) -> ArchiveStore:
    """A store whose texts come from the capture stream: gates, unchanged frames, text out of an HTML payload, stored batches."""
    payload = F.concat(F.lit("<h1>"), F.col("title"), F.lit("</h1><p>event "), F.col("seq").cast("string"), F.lit(" of "), F.col("window_id"), F.lit("</p>"))
    store, span = ArchiveStore(spark, scratch(spark, "ingest")), _span(spark, sf)
    frames = _inbox(spark, X.captures(spark, sf).withColumn("payload", payload), span)
    writer = SI.capture_stream(frames, _inbox(spark, X.states(spark, sf), span), store, lambda d: extract_html(d, "payload"), scratch(spark, "checkpoint"), "ERR")
    SI.start(writer, spark).awaitTermination()
    return store


@register("capture_stream", TEXTS)
def _(spark, sf):
    with _state_partitions(spark):
        return _ingested(spark, sf).read("texts").select("path", "text")


@register(
    "index_captured_texts",
    f"""WITH ingested AS ({TEXTS}), words AS (SELECT path, unnest({X.WORDS_SQL}) AS term FROM ingested)
    SELECT term, path, count(*) AS tf FROM words GROUP BY ALL""",
)
def _(spark, sf):
    """The chain from captures to a searchable index: texts of the capture stream, read by the index stream."""
    with _state_partitions(spark):
        store = _ingested(spark, sf)
        index_stream(SI.stored_texts(store), store, default_encoder(X.DIM), scratch(spark, "checkpoint"), backends=(KEYWORD,)).start().awaitTermination()
        return live_postings(store).select("term", "path", "tf")
