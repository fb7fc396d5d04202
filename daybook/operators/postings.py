"""The keyword index: postings, document lengths and term statistics.

The index is append-only. A posting belongs to the batch that wrote it, and `doc_stats` says
which batch of a document is current, so a changed or removed document needs no rewrite of old
postings: readers keep only postings whose batch is current.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.text import tokens
from daybook.functions.vectors import slices_of
from daybook.operators.backlog import changed_docs, of_their_days, removed_docs
from daybook.runtime import broadcast_if_small, durable
from daybook.sources.store import ArchiveStore

BUCKETS = 64


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def doc_lengths(docs: DataFrame, fold: bool = False) -> DataFrame:
    """(path, len) in words; row-local."""
    return docs.select("path", F.size(tokens(F.col("text"), fold)).cast("long").alias("len"))


def _posted(batches: Iterator[pa.RecordBatch], positions: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for rows, terms, doc, code in slices_of(batch.column(1)):
            key = doc * max(len(terms), 1) + code
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            ends = np.append(first, len(key))
            at_first = order[first]
            made = [terms.take(pa.array(code[at_first])), batch.column(0).take(pa.array(doc[at_first] + at)), pa.array(np.diff(ends))]
            if positions:
                place = order - np.searchsorted(doc, doc)[order]
                made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32())))
            at += len(rows)
            yield pa.RecordBatch.from_arrays(made, ["term", "path", "tf", "positions"][: len(made)])


def _postings_by_row(docs: DataFrame, fold: bool, positions: bool) -> DataFrame:
    """The postings of each row by itself; row-local."""
    words = docs.select(F.col("path").cast("string").alias("path"), tokens(F.col("text"), fold).alias("words"))
    return words.mapInArrow(partial(_posted, positions=positions), "term string, path string, tf long" + (", positions array<int>" if positions else ""))


def build_postings(docs: DataFrame, fold: bool = False, positions: bool = True, whole: bool = False) -> DataFrame:
    """(term, path, tf[, positions]): one row per word and document.

    Grouping is on term and path together, so a word found in every document is spread; words that a later join drops are dropped before.
    With `whole`, for callers that keep every posting, words are counted document by document and nothing but paths is shuffled; only
    documents whose path stands in several rows are grouped.
    """
    if whole:
        again = durable(docs.groupBy(F.col("path").alias("_path")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_path"))
        if again.isEmpty():
            return _postings_by_row(docs, fold, positions)
        again, same = broadcast_if_small(again, 1_000_000), F.col("path").eqNullSafe(F.col("_path"))
        several = build_postings(docs.join(again, same, "left_semi"), fold, positions)
        return _postings_by_row(docs.join(again, same, "left_anti"), fold, positions).unionByName(several)
    if not positions:
        words = docs.select("path", F.explode(tokens(F.col("text"), fold)).alias("term"))
        return words.groupBy("term", "path").agg(F.count(F.lit(1)).alias("tf"))
    words = docs.select("path", F.posexplode(tokens(F.col("text"), fold)).alias("pos", "term"))
    return words.groupBy("term", "path").agg(
        F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions")
    )


def term_statistics(postings: DataFrame) -> DataFrame:
    """Document frequency and total count per term."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))


def corpus_lengths(stats: DataFrame) -> DataFrame:
    """One row: number of documents and their average length in words."""
    return stats.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))


def spread_postings(postings: DataFrame) -> DataFrame:
    """Partition for writing by bucket. One term may fill a bucket: Spark's rebalancing splits
    large partitions by their measured size and merges small ones. A word's postings stand
    together, in the order of its hash, as comparing words and paths took most of the writing."""
    rows = postings.withColumn("bucket", bucket_of(F.col("term"))).hint("rebalance", F.col("bucket"))
    return rows.sortWithinPartitions("bucket", F.xxhash64("term"))


# -- stored index ------------------------------------------------------------------------------


def current_stats(store: ArchiveStore, without_batch: int | None = None) -> DataFrame:
    """The newest live entry of every document (path, len, mtime, batch)."""
    w = Window.partitionBy("path").orderBy(F.col("batch").desc())
    newest = store.read("doc_stats", without_batch).withColumn("_n", F.row_number().over(w))
    return newest.filter("_n = 1 AND NOT removed").drop("_n", "removed")


def live_postings(store: ArchiveStore, terms: DataFrame | None = None) -> DataFrame:
    """Current postings. With a table of terms, dynamic pruning reads only their buckets."""
    rows = store.read("postings")
    if terms is not None:
        wanted = terms.select("term").distinct().withColumn("bucket", bucket_of(F.col("term")))
        rows = rows.join(broadcast_if_small(wanted, 1_000_000), ["bucket", "term"], "left_semi")
    return rows.join(current_stats(store).select("path", "batch"), ["path", "batch"]).select(
        "term", "path", "tf", "positions"
    )


def update_keyword_index(store: ArchiveStore, docs: DataFrame, batch: int) -> DataFrame:
    """Index new and changed documents and drop removed ones; returns the documents indexed.

    The change is found from paths and times alone, and old postings are never rewritten.
    Repeating a batch replaces it.
    """
    known = current_stats(store, without_batch=batch)
    changed = durable(changed_docs(docs.select("path", "mtime"), known).select("path"))
    todo = of_their_days(docs, changed).join(broadcast_if_small(changed, 1_000_000), "path", "left_semi")
    store.append("postings", spread_postings(build_postings(todo, whole=True)), batch)
    entries = todo.select(
        "path", F.size(tokens(F.col("text"))).cast("long").alias("len"), "mtime", F.lit(False).alias("removed")
    )
    gone = removed_docs(known, docs).select("path", "len", "mtime", F.lit(True).alias("removed"))
    store.append("doc_stats", entries.unionByName(gone).withColumn("indexed_at", F.current_timestamp()), batch)
    return todo


def build_keyword_index(store: ArchiveStore, docs: DataFrame) -> DataFrame:
    """A fresh index over all documents."""
    store.reset("postings")
    store.reset("doc_stats")
    return update_keyword_index(store, docs, batch=0)
