"""Table shapes shared by all operators (timestamps are instants; run with a UTC session)."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

CAPTURES = T.StructType([
    T.StructField("window_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("frame_hash", T.StringType()),
])

DOCS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("window_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("text", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("size", T.LongType()),
])

STATES = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("active", T.BooleanType()),
])

VECTORS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("vec", VECTOR),
    T.StructField("dim", T.IntegerType()),
    T.StructField("encoder", T.StringType()),
    T.StructField("indexed_at", T.TimestampType()),
])

POSTINGS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("tf", T.LongType()),
    T.StructField("positions", T.ArrayType(T.IntegerType())),
])

DOC_STATS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("len", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("removed", T.BooleanType()),
    T.StructField("indexed_at", T.TimestampType()),
])

FORWARD = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("len", T.LongType()),
    T.StructField("terms", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))),
])

BLOCKS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("max_tf", T.LongType()),
    T.StructField("min_len", T.LongType()),
    T.StructField("entries", T.ArrayType(T.StructType([
        T.StructField("hash", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("tf", T.LongType()),
        T.StructField("len", T.LongType()),
    ]))),
])

TERM_COUNTS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("added", T.LongType()),
    T.StructField("gone", T.LongType()),
    T.StructField("level", T.IntegerType()),
])

CORPUS = T.StructType([
    T.StructField("n_docs", T.LongType()),
    T.StructField("n_texts", T.LongType()),
    T.StructField("total_len", T.LongType()),
])

DEAD = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("dead_batch", T.LongType()),
    T.StructField("len", T.LongType()),
])

SKIPPED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("reason", T.StringType()),
])

CYCLES = T.StructType([
    T.StructField("discovered", T.LongType()),
    T.StructField("queued", T.LongType()),
    T.StructField("added", T.LongType()),
    T.StructField("failed_batches", T.LongType()),
    T.StructField("elapsed_s", T.DoubleType()),
    T.StructField("index_size", T.LongType()),
    T.StructField("finished_at", T.TimestampType()),
])

DEAD_LETTERS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("error", T.StringType()),
])

PROC_SAMPLES = T.StructType([
    T.StructField("sample_ts", T.TimestampType()),
    T.StructField("pid", T.LongType()),
    T.StructField("cmdline", T.StringType()),
    T.StructField("cpu", T.DoubleType()),
    T.StructField("rss", T.LongType()),
    T.StructField("io_read", T.LongType()),
    T.StructField("io_write", T.LongType()),
])

HITS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("distance", T.DoubleType()),
])

# Store tables: row shape and the directory levels below the batch level.
STORE_TABLES: dict[str, tuple[T.StructType, list[str]]] = {
    "texts": (DOCS, ["day"]),
    "frames": (
        T.StructType([
            T.StructField("path", T.StringType()),
            T.StructField("mtime", T.TimestampType()),
            T.StructField("size", T.LongType()),
        ]),
        ["day"],
    ),
    "vectors": (VECTORS, []),
    "postings": (POSTINGS, ["bucket"]),
    "doc_stats": (DOC_STATS, []),
    "forward": (FORWARD, ["shelf"]),
    "blocks": (BLOCKS, ["bucket"]),
    "term_counts": (TERM_COUNTS, ["bucket"]),
    "corpus": (CORPUS, []),
    "dead": (DEAD, []),
    "skipped": (SKIPPED, []),
    "dead_letters": (DEAD_LETTERS, []),
    "cycles": (CYCLES, []),
}


def stored(table: str) -> T.StructType:
    """Row shape of a store table including its directory columns."""
    schema, levels = STORE_TABLES[table]
    fields = list(schema.fields) + [T.StructField("batch", T.LongType())]
    kinds = {"day": T.DateType(), "bucket": T.IntegerType(), "shelf": T.IntegerType()}
    return T.StructType(fields + [T.StructField(c, kinds[c]) for c in levels])
