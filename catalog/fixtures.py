"""The archive tables derived from the given tables, once as DataFrames and once as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.text import tokens
from daybook.operators.backlog import assign_ids
from daybook.operators.embed import default_encoder, embed_texts
from daybook.operators.postings import build_postings, doc_lengths
from daybook.operators.ranked import build_ranked_index
from daybook.plans.cycle import store_vectors
from daybook.runtime import scratch, stored, widen
from daybook.sources.store import ArchiveStore

# First capture instant (2024-01-01 UTC), the "now" of age rules, encoder size.
BASE = 1704067200
NOW = dt.datetime(2024, 2, 11, 12, 30, 0, tzinfo=dt.timezone.utc)
NOW_SQL = "TIMESTAMP '2024-02-11 12:30:00'"
DIM = 64
MARKERS = ["indexer", "Index cycle done"]
NEEDLES = ["click", "sign"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Instants are UTC, so the session time zone is pinned to it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table with long texts, whose per-row work should use all cores."""
    return widen(table(spark, sf, name))


def us(ts: Column | str) -> Column:
    """Instants leave a query as microseconds, free of time zone conversion."""
    return F.unix_micros(ts)


# -- documents ---------------------------------------------------------------------------------


def docs(spark: SparkSession, sf: str) -> DataFrame:
    epoch = F.lit(BASE) + F.col("doc_id") * 3600
    return texts(spark, sf, "documents").select(
        F.concat("source", F.lit("_"), epoch.cast("string"), F.lit(".txt")).alias("path"),
        F.col("source").alias("window_id"),
        F.timestamp_seconds(epoch).alias("ts"),
        "text",
        F.timestamp_seconds(epoch).alias("mtime"),
        F.octet_length("text").cast("long").alias("size"),
        "doc_id",
    )


DOCS = f"""docs AS (
  SELECT source || '_' || ({BASE} + doc_id * 3600)::VARCHAR || '.txt' AS path, source AS window_id,
         {BASE} + doc_id * 3600 AS epoch, make_timestamp(({BASE} + doc_id * 3600) * 1000000) AS ts, text,
         make_timestamp(({BASE} + doc_id * 3600) * 1000000) AS mtime, strlen(text) AS size, doc_id
  FROM documents)"""


def blanked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which every tenth holds only white space."""
    d = docs(spark, sf)
    text = (
        F.when(F.col("doc_id") % 20 == 0, F.lit("\t\n "))
        .when(F.col("doc_id") % 10 == 0, F.lit("  "))
        .otherwise(F.col("text"))
    )
    return d.withColumn("text", text)


BLANKED = DOCS + r""", blanked AS (
  SELECT * REPLACE (CASE WHEN doc_id % 20 = 0 THEN chr(9) || chr(10) || ' '
                         WHEN doc_id % 10 = 0 THEN chr(160) || chr(8195) ELSE text END AS text) FROM docs)"""
NOT_BLANK_SQL = r"regexp_matches(text, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]')"


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).filter("doc_id % 3 = 0")


# -- text index --------------------------------------------------------------------------------


def text_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Postings and document lengths, built once and kept, as several searches read them."""
    d = docs(spark, sf)
    return stored(build_postings(d, positions=False, whole=True), "postings"), stored(doc_lengths(d), "lengths")


_ARCHIVES: dict[tuple[str, str], ArchiveStore] = {}


def archive(spark: SparkSession, sf: str) -> ArchiveStore:
    """The kept index over all documents, keywords and vectors, filled once per application and folder; searches read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ARCHIVES:
        store, d = ArchiveStore(spark, scratch(spark, "archive")), docs(spark, sf)
        build_ranked_index(store, d)
        encoder = default_encoder(DIM)
        # The ids are joined to vectors, which are shorter than texts.
        store_vectors(store, assign_ids(embed_texts(d.select("path", "text"), encoder).select("path", "vec")), encoder, 0)
        _ARCHIVES[key] = store
    return _ARCHIVES[key]


_COUNTED: dict[tuple[str, str], ArchiveStore] = {}


def counted_archive(spark: SparkSession, sf: str) -> ArchiveStore:
    """Texts in four batches by age, vectors, and a keyword index that was last written when the middle document was captured; filled once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _COUNTED:
        store, d = ArchiveStore(spark, scratch(spark, "counted")), docs(spark, sf).withColumn("day", F.to_date("mtime"))
        last = d.agg(F.max("doc_id")).first()[0] or 0
        for k in range(4):
            store.append("texts", d.filter(F.least(F.floor(F.col("doc_id") * 4 / (last + 1)), F.lit(3)) == k), k)
        indexed = d.filter(F.col("doc_id") <= last // 2)
        store.append("doc_stats", indexed.select("path", F.lit(0).cast("long").alias("len"), "mtime", F.lit(False).alias("removed"), F.col("mtime").alias("indexed_at")), 0)
        store.append("vectors", vectors(spark, sf), 0)
        _COUNTED[key] = store
    return _COUNTED[key]


WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

TEXT_INDEX = DOCS + f""", words AS (SELECT path, unnest({WORDS_SQL}) AS term FROM docs),
postings AS (SELECT term, path, count(*) AS tf FROM words GROUP BY ALL),
stats AS (SELECT path, len({WORDS_SQL}) AS len FROM docs)"""


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Search texts: all words of every benchmark item."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array_join(tokens(F.col("text")), " ").alias("text")
    )


def barred_words(spark: SparkSession, sf: str) -> DataFrame:
    """A word to exclude from each search: the alphabetically last one of the item."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array_max(tokens(F.col("text"))).alias("text")
    )


def queries_sql() -> str:
    return f"""queries AS (SELECT item_id AS query_id, array_to_string({WORDS_SQL}, ' ') AS text FROM benchmark)"""


TERMS_SQL = f"""terms AS (SELECT DISTINCT query_id, unnest({WORDS_SQL}) AS term FROM queries),
n_terms AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1)"""

MATCH_ALL_SQL = """matched AS (SELECT query_id, path FROM terms JOIN postings USING (term) JOIN n_terms USING (query_id)
  GROUP BY query_id, path, n HAVING count(*) = n)"""

BM25_SQL = """corpus AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM stats),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1)"""
BM25_PART = "ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))"


# -- vectors -----------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The given embeddings as an index; vector i belongs to the document with the same number."""
    sources = docs(spark, sf).select("doc_id", "window_id")
    return (
        table(spark, sf, "embeddings")
        .join(sources, F.col("vec_id") == F.col("doc_id"), "left")
        .select(
            F.col("vec_id").alias("id"),
            F.concat(
                F.coalesce("window_id", F.lit("gone")),
                F.lit("_"),
                (F.lit(BASE) + F.col("vec_id") * 3600).cast("string"),
                F.lit(".txt"),
            ).alias("path"),
            F.col("embedding").alias("vec"),
            F.lit(DIM).alias("dim"),
            F.lit("given").alias("encoder"),
            F.timestamp_seconds(F.lit(BASE) + F.col("vec_id") * 60).alias("indexed_at"),
            F.floor(F.col("vec_id") / 100).alias("batch"),
        )
    )


VECTORS = DOCS + f""", vectors AS (
  SELECT vec_id AS id, coalesce(window_id, 'gone') || '_' || ({BASE} + vec_id * 3600)::VARCHAR || '.txt' AS path,
         embedding AS vec, make_timestamp(({BASE} + vec_id * 60) * 1000000) AS indexed_at
  FROM embeddings LEFT JOIN docs ON vec_id = doc_id)"""

DISTANCE_SQL = "round(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)), 6)"


def embedded_sql(name: str, source: str, key: str) -> str:
    """SQL twin of the hashed encoder: `name`(key, vec FLOAT[DIM])."""
    return f"""{name}_tf AS (SELECT {key}, term, count(*) AS tf
  FROM (SELECT {key}, unnest({WORDS_SQL}) AS term FROM {source}) GROUP BY ALL),
{name}_slots AS (SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS slot,
  sum((1 - 2 * (('0x' || substr(md5(term), 9, 1))::BIGINT % 2)) * ln(1 + tf)) AS v FROM {name}_tf GROUP BY ALL),
{name}_norms AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name}_slots GROUP BY 1),
{name} AS (SELECT {key}, list((CASE WHEN norm > 0 THEN coalesce(v, 0) / norm ELSE 0 END)::FLOAT ORDER BY slot) AS vec
  FROM (SELECT {key}, slot FROM {source}, (SELECT unnest(range({DIM})) AS slot))
  LEFT JOIN {name}_slots USING ({key}, slot) LEFT JOIN {name}_norms USING ({key}) GROUP BY {key})"""


# -- captures, states, samples, logs -----------------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def captures(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return events(spark, sf).select(
        user.alias("window_id"),
        user.alias("session"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("title"),
        F.col("event_type").alias("frame_hash"),
    )


CAPTURES = """captures AS (SELECT user_id::VARCHAR AS window_id, user_id::VARCHAR AS session, ts, event_id AS seq,
  event_type AS title, event_type AS frame_hash FROM events)"""


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Lock and suspend signals: one event type switches on, another off."""
    kind = F.col("event_type")
    return (
        events(spark, sf)
        .filter(kind.isin("signup", "purchase", "error", "view"))
        .select(
            F.col("user_id").cast("string").alias("session"),
            "ts",
            F.col("event_id").alias("seq"),
            F.when(kind.isin("signup", "purchase"), F.lit("lock")).otherwise(F.lit("suspend")).alias("kind"),
            kind.isin("signup", "error").alias("active"),
        )
    )


STATES = """states AS (SELECT user_id::VARCHAR AS session, ts, event_id AS seq,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'lock' ELSE 'suspend' END AS kind,
  event_type IN ('signup', 'error') AS active
  FROM events WHERE event_type IN ('signup', 'purchase', 'error', 'view'))"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.select(
        F.date_trunc("hour", "ts").alias("sample_ts"),
        F.col("user_id").alias("pid"),
        F.concat(F.lit("python "), "event_type", F.lit(".py")).alias("cmdline"),
        F.floor("value").cast("double").alias("cpu"),
        (F.col("event_id") * 4096).alias("rss"),
        (F.col("event_id") * 3).alias("io_read"),
        (F.col("event_id") * 7).alias("io_write"),
    )


SAMPLES = """samples AS (SELECT date_trunc('hour', ts) AS sample_ts, user_id AS pid, 'python ' || event_type || '.py' AS cmdline,
  floor(value) AS cpu, event_id * 4096 AS rss, event_id * 3 AS io_read, event_id * 7 AS io_write FROM events)"""


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log lines; every 97th ends an index cycle, every 50th is followed by no record."""
    n = F.col("event_id")
    message = (
        F.when(
            n % 97 == 0,
            F.concat(
                F.lit("Index cycle done: Added "), (n % 13).cast("string"), F.lit(" non-empty files (out of "),
                (n % 13 + 2).cast("string"), F.lit(" discovered) in "), (n % 7).cast("string"), F.lit(".5 seconds."),
            ),
        )
        .when(n % 97 == 1, F.concat(F.lit("Flushed batch of "), (n % 64).cast("string"), F.lit(" files.")))
        .otherwise(F.concat(F.lit("seen "), F.col("event_type")))
    )
    record = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"),
        F.when(n % 97 <= 1, F.lit(" - indexer - INFO - ")).otherwise(F.lit(" - daemon - DEBUG - ")),
        message,
    )
    line = F.when(n % 50 == 49, F.lit("Traceback (most recent call last):")).otherwise(record)
    return events(spark, sf).select(n.alias("line_no"), line.alias("line"))


LOGS = r"""log_lines AS (SELECT event_id AS line_no, CASE WHEN event_id % 50 = 49 THEN 'Traceback (most recent call last):' ELSE
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || substr(strftime(ts, '%f'), 1, 3) ||
  CASE WHEN event_id % 97 <= 1 THEN ' - indexer - INFO - ' ELSE ' - daemon - DEBUG - ' END ||
  CASE WHEN event_id % 97 = 0 THEN 'Index cycle done: Added ' || (event_id % 13)::VARCHAR || ' non-empty files (out of ' ||
         (event_id % 13 + 2)::VARCHAR || ' discovered) in ' || (event_id % 7)::VARCHAR || '.5 seconds.'
       WHEN event_id % 97 = 1 THEN 'Flushed batch of ' || (event_id % 64)::VARCHAR || ' files.'
       ELSE 'seen ' || event_type END END AS line FROM events),
logs AS (SELECT line_no, line,
  CASE WHEN regexp_matches(line, '^\d{4}') THEN strptime(substr(line, 1, 23), '%Y-%m-%d %H:%M:%S,%g') END AS ts,
  CASE WHEN regexp_matches(line, '^\d{4}') THEN split_part(line, ' - ', 2) END AS logger,
  CASE WHEN regexp_matches(line, '^\d{4}') THEN split_part(line, ' - ', 3) END AS level,
  CASE WHEN regexp_matches(line, '^\d{4}') THEN split_part(line, ' - ', 4) END AS message FROM log_lines)"""


def frame_files(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frame files with a time and a size."""
    e = events(spark, sf)
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("_"), F.col("event_id").cast("string"), F.lit(".png")).alias("path"),
        F.col("ts").alias("mtime"),
        (F.col("event_id") * 100 + 7).alias("size"),
    )


FRAMES = """frames AS (SELECT user_id::VARCHAR || '_' || event_id::VARCHAR || '.png' AS path, ts AS mtime,
  event_id * 100 + 7 AS size FROM events)"""
