"""The index cycle as a stream: each micro-batch of new documents is one durable batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from daybook.functions.text import tokens
from daybook.operators.backlog import assign_ids
from daybook.operators.embed import Encoder, index_state
from daybook.operators.postings import build_postings, spread_postings
from daybook.plans.cycle import append_vectors, load_vector_index, pending_work, record_skipped
from daybook.plans.search import BACKENDS, KEYWORD, SEMANTIC
from daybook.runtime import read_text
from daybook.sources.store import ArchiveStore


def index_batch(
    store: ArchiveStore, docs: DataFrame, encoder: Encoder, batch: int, backends: tuple[str, ...] = BACKENDS
) -> None:
    """Index new documents as one batch of the store. Tables that have the batch already are left as they are.

    Of a path that arrives several times the newest document counts. The documents are kept in memory or on disk while the
    tables are written, so they are read and tokenised once.
    """
    newest = Window.partitionBy("path").orderBy(F.col("mtime").desc(), F.xxhash64("text"))
    docs = docs.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n").persist()
    try:
        if KEYWORD in backends:
            if not store.has_batch("postings", batch):
                store.append("postings", spread_postings(build_postings(docs, whole=True)), batch)
            if not store.has_batch("doc_stats", batch):
                length = F.size(tokens(F.col("text"))).cast("long")
                entries = docs.select("path", length.alias("len"), "mtime", F.lit(False).alias("removed"))
                store.append("doc_stats", entries.withColumn("indexed_at", F.current_timestamp()), batch)
        if SEMANTIC in backends and not store.has_batch("vectors", batch):
            state = index_state(load_vector_index(store, without_batch=batch), encoder)
            work, _ = pending_work(store, docs, without_batch=batch)
            record_skipped(store, work, batch)
            numbered = docs.join(assign_ids(work.paths, state.next_id), "path")
            append_vectors(store, numbered, encoder, batch)
    finally:
        docs.unpersist()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave to the stream of a checkpoint folder; a new folder is a new stream."""
    return json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]


def index_stream(
    docs: DataFrame, store: ArchiveStore, encoder: Encoder, checkpoint: str,
    every: str | None = None, backends: tuple[str, ...] = BACKENDS,
) -> DataStreamWriter:
    """Keyword, then vector index for each micro-batch of a document stream.

    The source's maxFilesPerTrigger is the cap per cycle; what is left waits for the next. Micro-batches take reserved batch
    numbers of the store, so cycles and other streams may write between them.
    """

    def write(df: DataFrame, step: int) -> None:
        index_batch(store, df, encoder, store.reserve(stream_id(store.spark, checkpoint), step), backends)

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
