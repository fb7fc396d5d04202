"""Ranked keyword search over a kept index: posting blocks with impact bounds, maintained counts, and a document-to-terms table.

Per batch the store keeps
  forward      path, length and terms of each document, in shelves by path: a document's words without reading any posting
  blocks       the postings of a term in blocks of about `BLOCK`, cut by a hash of the path, each with its largest count and smallest length
  term_counts  per term the documents that the batch added and those it took away, so document frequencies are sums over batches
  corpus       one row: documents and words added less those taken away
  dead         (path, batch) of documents that the batch replaced or removed
Texts are tokenised once, into `forward`; the other tables are derived from it. No old row is ever rewritten.

A search looks at block heads first. For each query the rarest required word leads; its blocks are ranked by the score that no document in them
can exceed, the best ones are scored, and of the rest only blocks whose bound reaches the k-th best score found. Other words are looked up in
the one block that a candidate's hash points to. The rows are those of a full BM25 ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.text import tokens
from daybook.functions.vectors import counted
from daybook.operators.backlog import changed_docs, of_their_days, removed_docs
from daybook.operators.keyword import B, K1, QUERY_TERM_ROWS, bm25, query_terms
from daybook.operators.refine import heaviest, with_added
from daybook.runtime import broadcast_if_small, durable, fits, freed_shuffles, small
from daybook.sources.store import ArchiveStore

#: Folders of a batch. Up to 32, Spark lists them without a job of its own.
BUCKETS, SHELVES, BLOCK = 32, 32, 128
#: Postings that a task puts together in blocks, about, and terms of several blocks that are broadcast; more of these are joined by shuffle.
CELL_POSTINGS, LEVELLED_ROWS = 250_000, 1_000_000
#: More postings than these are put together in rounds, each for a part of the buckets, and at most in so many: each round reads `forward` again.
ROUND_POSTINGS, ROUNDS = 3_500_000, 6
#: Blocks per query that are scored before the others are weighed against the result.
SEEDS = 8
#: Words that a query is taken to have when rows are counted for a broadcast.
ASKED = 32
#: Candidates whose places in blocks are broadcast.
FEW = QUERY_TERM_ROWS // ASKED
#: Scores are rounded to six digits before ranking; a block that may reach the last place within that still counts.
SLACK = 1e-6
TABLES = ("forward", "blocks", "term_counts", "corpus", "dead")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def shelf_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(SHELVES)).cast("int")


def block_of(hashed: Column, level: Column) -> Column:
    """The first `level` bits of a hash."""
    # Shifts take their distance modulo 64, so no bits at all are a case of their own.
    return F.when(level == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", hashed, (64 - level).cast("int")))


# -- building -----------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for rows, terms, doc, code, tf in counted(batch.column(2)):
            ends = pa.array(np.searchsorted(doc, np.arange(len(rows) + 1)), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([terms.take(pa.array(code)), pa.array(tf, pa.int64())], ["term", "tf"]))
            part = batch.slice(at, len(rows))
            at += len(rows)
            lengths = pc.list_value_length(rows).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lengths, lists], ["path", "mtime", "len", "terms"])


def forward_rows(docs: DataFrame) -> DataFrame:
    """path, mtime, len, terms (term, tf) of each document."""
    words = docs.select("path", "mtime", tokens(F.col("text")).alias("words"))
    return words.mapInArrow(_counted, "path string, mtime timestamp, len long, terms array<struct<term: string, tf: bigint>>")


def in_shelves(rows: DataFrame) -> DataFrame:
    """Rows of `forward` with their shelf, dealt out by it. A document's words travel as one string (no word holds a blank) beside their counts."""
    flat = rows.select("path", "mtime", "len", F.array_join("terms.term", " ").alias("words"), F.col("terms.tf").alias("tfs"), shelf_of(F.col("path")).alias("shelf"))
    words = F.when(F.size("tfs") > 0, F.split("words", " ")).otherwise(F.array().cast("array<string>"))
    terms = F.arrays_zip(words.alias("term"), F.col("tfs").alias("tf")).cast("array<struct<term: string, tf: bigint>>")
    dealt = flat.hint("rebalance", F.col("shelf")).select("path", "mtime", "len", terms.alias("terms"), "shelf")
    return dealt.sortWithinPartitions("shelf", "path")


def live_documents(store: ArchiveStore, without_batch: int | None = None) -> DataFrame:
    """(path, mtime, len, batch) of the documents in the index."""
    dead = store.read("dead", without_batch).select("path", F.col("dead_batch").alias("batch"))
    return store.read("forward", without_batch).select("path", "mtime", "len", "batch").join(dead, ["path", "batch"], "left_anti")


def update_ranked_index(store: ArchiveStore, docs: DataFrame, batch: int) -> None:
    """Take in new and changed documents of `docs`, the whole present archive, and drop removed ones. Repeating a batch replaces it."""
    with freed_shuffles(store.spark):
        _update(store, docs, batch)


def _update(store: ArchiveStore, docs: DataFrame, batch: int) -> None:
    spread = lambda df, level, *order: df.hint("rebalance", F.col(level)).sortWithinPartitions(level, *order)
    known = durable(live_documents(store, without_batch=batch))
    changed = durable(changed_docs(docs.select("path", "mtime"), known).select("path"))
    if known.isEmpty():
        # All documents are new: their texts meet no list of paths, which for very many paths would take a shuffle of the texts.
        todo = docs.filter(F.col("path").isNotNull())
    else:
        todo = of_their_days(docs, changed).join(broadcast_if_small(changed, QUERY_TERM_ROWS), "path", "left_semi")
    store.append("forward", in_shelves(forward_rows(todo)), batch)
    replaced = known.join(changed, "path", "left_semi")
    gone = replaced.unionByName(removed_docs(known, docs)).select("path", F.col("batch").alias("dead_batch"), "len")
    store.append("dead", gone, batch)
    dead = store.read("dead").filter(F.col("batch") == batch)
    fresh = store.read("forward").filter(F.col("batch") == batch).select("path", "len", "terms")

    postings = fresh.select("path", "len", F.inline("terms"))
    added = postings.groupBy("term").agg(F.count("*").alias("added"))
    old = store.read("forward", batch).select("path", F.col("batch").alias("dead_batch"), "terms")
    lost = old.join(dead.select("path", "dead_batch"), ["path", "dead_batch"]).select(F.inline("terms"))
    lost = lost.groupBy("term").agg(F.count("*").alias("gone"))
    zero = F.lit(0).cast("long")
    both = added.withColumn("gone", zero).unionByName(lost.withColumn("added", zero)).groupBy("term").agg(F.sum("added").alias("added"), F.sum("gone").alias("gone"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("added"), F.lit(1)) / BLOCK))).cast("int")
    store.append("term_counts", spread(both.withColumns({"level": level, "bucket": bucket_of(F.col("term"))}), "bucket", "term"), batch)

    counts = store.read("term_counts").filter(F.col("batch") == batch)
    n_postings = counts.agg(F.sum("added")).first()[0] or 0
    levels = counts.filter("level > 0 AND added > 0").select("term", "level")
    levels, rounds = broadcast_if_small(levels, LEVELLED_ROWS), min(ROUNDS, max(1, math.ceil(n_postings / ROUND_POSTINGS)))
    if rounds == 1:
        store.append("blocks", in_blocks(postings, levels, n_postings), batch)
    else:
        turn = F.pmod(bucket_of(F.col("term")), F.lit(rounds))
        store.append_parts("blocks", (in_blocks(postings.filter(turn == i), levels, n_postings, rounds) for i in range(rounds)), batch)

    sums = lambda df: df.agg(F.count("*").alias("n_docs"), F.count("len").alias("n_texts"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"))
    less = sums(dead).select(*(F.col(c).alias(f"_{c}") for c in ("n_docs", "n_texts", "total_len")))
    store.append("corpus", sums(fresh).crossJoin(less).select(*((F.col(c) - F.col(f"_{c}")).alias(c) for c in ("n_docs", "n_texts", "total_len"))), batch)


def in_blocks(postings: DataFrame, levels: DataFrame, n_postings: int, rounds: int = 1) -> DataFrame:
    """Postings (term, path, tf, len) put together in blocks, by one shuffle; `levels` (term, level) has the terms of more than one block.
    They are those of one of `rounds` equal parts of the buckets; `n_postings` counts all.

    Blocks are dealt out by cells, each a part of one bucket, so few files fall to a bucket and a term of very many blocks is spread.
    """
    slots = max(1, math.ceil(n_postings / BUCKETS / CELL_POSTINGS))
    hashed, block = F.xxhash64("path"), block_of(F.col("hash"), F.col("level"))
    placed = postings.join(levels, "term", "left").withColumn("level", F.coalesce("level", F.lit(0))).withColumn("hash", hashed)
    cell = bucket_of(F.col("term")) * slots + F.pmod(F.xxhash64("term", block), F.lit(slots)).cast("int")
    dealt = placed.select("term", "path", "tf", "len", "level", cell.alias("cell")).repartition(-(-BUCKETS // rounds) * slots, "cell")
    # What follows from a row is not shuffled.
    whole = dealt.withColumn("hash", hashed).withColumn("block", block)
    lists = whole.groupBy("cell", "term", "block").agg(
        F.first("level").alias("level"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"),
        F.sort_array(F.collect_list(F.struct("hash", "path", "tf", "len"))).alias("entries"),
    )
    return lists.withColumn("bucket", bucket_of(F.col("term"))).sortWithinPartitions("bucket", "term", "block")


def build_ranked_index(store: ArchiveStore, docs: DataFrame) -> None:
    """A fresh index over all documents."""
    for table in TABLES:
        store.reset(table)
    update_ranked_index(store, docs, batch=0)


# -- searching ----------------------------------------------------------------------------------


@dataclass
class Trace:
    """What a search opened: buckets, block heads, and blocks whose postings were read as candidates in each round."""

    buckets: list[int] = field(default_factory=list)
    heads: DataFrame | None = None
    rounds: list[DataFrame] = field(default_factory=list)


def document_frequencies(store: ArchiveStore, wanted: DataFrame, buckets: list[int]) -> DataFrame:
    """(term, df) of the terms that any document holds, summed over batches. `wanted` has the terms, each once."""
    counts = store.read("term_counts").filter(F.col("bucket").isin(buckets)).join(wanted, "term", "left_semi")
    return counts.groupBy("term").agg((F.sum("added") - F.sum("gone")).alias("df")).filter("df > 0")


def buckets_of(terms: DataFrame) -> tuple[list[int], bool]:
    """The buckets of some terms, numbers below the fixed number of buckets, and whether the terms are few enough to broadcast."""
    buckets, n = terms.agg(F.collect_set(bucket_of(F.col("term"))), F.count("*")).first()
    return sorted(buckets), n <= QUERY_TERM_ROWS


def corpus_counts(store: ArchiveStore) -> tuple[int, float]:
    """Documents and mean length, from one row per batch."""
    n = store.read("corpus").agg(F.sum("n_docs"), F.sum("n_texts"), F.sum("total_len")).first()
    return n[0] or 0, (n[2] / n[1]) if n[1] else 1.0


def ranked_search(store: ArchiveStore, queries: DataFrame, k: int = 10, optional: DataFrame | None = None, trace: Trace | None = None) -> DataFrame:
    """Top `k` documents per query by BM25: (query_id, rank, path, score), ties by path. All words of a query are required.

    `optional` (query_id, text) adds words that raise the score but are not required.
    """
    trace = trace or Trace()
    terms = query_terms(queries).select("query_id", "term", F.lit(1).alias("required"))
    if optional is not None:
        extra = query_terms(optional).select("query_id", "term", F.lit(0).alias("required"))
        terms = terms.unionByName(extra).groupBy("query_id", "term").agg(F.max("required").alias("required"))
    terms = durable(terms)
    n_docs, avg_len = corpus_counts(store)
    trace.buckets, bounded = buckets_of(terms)
    wanted = small(terms.select("term").distinct(), bounded)
    blocks = store.read("blocks").filter(F.col("bucket").isin(trace.buckets))
    heads = durable(blocks.select("term", "batch", "bucket", "block", "level", "max_tf", "min_len").join(wanted, "term", "left_semi"))
    trace.heads = heads

    part = lambda tf, length: bm25(tf, F.col("df"), length, F.lit(n_docs), F.lit(avg_len))
    # Null lengths do not stand in blocks: a document without text has no terms.
    reach = F.max(F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + K1 * (1 - B + B * F.col("min_len") / avg_len)))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    sized = terms.join(document_frequencies(store, wanted, trace.buckets), "term", "left").join(heads.groupBy("term").agg(reach.alias("reach")), "term", "left")
    sized = durable(sized.withColumn("most", F.coalesce(idf * F.col("reach"), F.lit(0.0))))

    # The rarest required word leads; a required word that no document holds leaves a query without hits.
    rare = F.min(F.when(F.col("required") == 1, F.struct("df", "term", "most"))).alias("rare")
    plans = sized.groupBy("query_id").agg(
        rare, F.sum("required").alias("n_required"), F.sum("most").alias("all"), F.count_if((F.col("required") == 1) & F.col("df").isNull()).alias("absent")
    )
    plans = plans.filter("absent = 0 AND n_required > 0").select(
        "query_id", F.col("rare.term").alias("term"), F.col("rare.df").alias("df"), "n_required", (F.col("all") - F.col("rare.most")).alias("rest")
    )
    led = heads.join(small(plans, bounded), "term")
    ranked = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "batch", "block")
    led = led.withColumn("bound", part(F.col("max_tf"), F.col("min_len")) + F.col("rest")).withColumn("place", F.row_number().over(ranked))
    led = durable(led.select("query_id", "term", "batch", "bucket", "block", "bound", "place", "n_required"))

    weighed = small(sized.filter("df IS NOT NULL").select("query_id", "term", "required", "df"), bounded)
    levels = small(heads.select("term", "batch", "level").distinct(), bounded)
    score = lambda chosen: _scored(store, blocks, chosen, weighed, levels, part, bounded)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path")
    seeds, others = led.filter(F.col("place") <= SEEDS), led.filter(F.col("place") > SEEDS)
    found = score(seeds)
    trace.rounds = [seeds]
    if not others.isEmpty():
        found = durable(found)
        last = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        others = others.join(last, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).drop("least")
        trace.rounds.append(others)
        found = found.unionByName(score(others))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "path", "score")


def _scored(store: ArchiveStore, blocks: DataFrame, chosen: DataFrame, weighed: DataFrame, levels: DataFrame, part, bounded: bool) -> DataFrame:
    """(query_id, path, score) of the documents in the chosen lead blocks that hold all required words of their query.

    Candidates are looked up under each word of their query, in the one block that their hash points to. They travel to the blocks where
    they are counted and few; otherwise both sides are shuffled.
    """
    at = ["term", "batch", "bucket", "block"]
    posted = blocks.select(*at, "entries")
    dead = store.read("dead").select("path", F.col("dead_batch").alias("batch"))
    lead = posted.join(small(chosen.select("query_id", "n_required", *at), bounded), at)
    held = lead.select("query_id", "n_required", "batch", F.inline("entries")).join(dead, ["path", "batch"], "left_anti").drop("tf")
    held = durable(held)
    few = fits(held, FEW)
    if not few and bounded and fits(held, QUERY_TERM_ROWS):
        met = _met_by_path(posted, held, weighed)
    else:
        asked = held.join(weighed, "query_id").join(levels, ["term", "batch"])
        asked = asked.withColumns({"block": block_of(F.col("hash"), F.col("level")), "bucket": bucket_of(F.col("term"))}).drop("level", "hash")
        met = posted.join(small(asked, few), at).withColumn("at", F.array_position("entries.path", F.col("path"))).filter("at > 0")
        met = met.withColumn("tf", F.element_at("entries.tf", F.col("at").cast("int")))
    tf = F.col("tf")
    rows = met.select("query_id", "path", "n_required", "required", part(tf, F.col("len")).alias("part"))
    sums = rows.groupBy("query_id", "path").agg(
        F.round(F.sum("part"), 6).alias("score"), F.sum("required").alias("found"), F.first("n_required").alias("n_required")
    )
    return sums.filter("found = n_required").select("query_id", "path", "score")


def _met_by_path(posted: DataFrame, held: DataFrame, weighed: DataFrame) -> DataFrame:
    """Candidates and the postings of their query's words, by path: the candidates are broadcast, and postings of other documents go no further.

    Shuffling the blocks to the candidates would move the lists of all words of the queries, the larger part of an index.
    """
    words = F.broadcast(weighed.select("term").distinct())
    postings = posted.join(words, "term", "left_semi").select("term", "batch", F.inline("entries"))
    found = postings.join(F.broadcast(held.select("path").distinct()), "path", "left_semi")
    # Of postings of the same path, which a document in several rows has, the first of the list counts.
    found = found.groupBy("term", "batch", "path").agg(F.min(F.struct("tf", "len")).alias("first")).select("term", "batch", "path", F.col("first.tf").alias("tf"))
    return found.join(F.broadcast(held), ["path", "batch"]).join(weighed, ["query_id", "term"])


# -- feedback -----------------------------------------------------------------------------------


def terms_of(store: ArchiveStore, paths: DataFrame) -> DataFrame:
    """(path, len, terms) of live documents, looked up in their shelves."""
    at = paths.select("path").distinct().withColumn("shelf", shelf_of(F.col("path")))
    dead = store.read("dead").select("path", F.col("dead_batch").alias("batch"))
    rows = store.read("forward").join(broadcast_if_small(at, QUERY_TERM_ROWS), ["shelf", "path"], "left_semi")
    return rows.join(dead, ["path", "batch"], "left_anti").select("path", "len", "terms")


def feedback_of_store(store: ArchiveStore, queries: DataFrame, n_docs: int = 5, n_terms: int = 5) -> DataFrame:
    """(query_id, term, weight): words most typical of a query's top documents, from their rows of `forward`; no posting is read for them."""
    top = durable(ranked_search(store, queries, n_docs).select("query_id", "path"))
    seen = terms_of(store, top).join(top, "path").select("query_id", "len", F.inline("terms"))
    seen = seen.groupBy("query_id", "term").agg(F.sum(F.col("tf") / F.col("len")).alias("_w"))
    seen = durable(seen.join(query_terms(queries).select("query_id", "term"), ["query_id", "term"], "left_anti"))
    buckets, bounded = buckets_of(seen)
    df = document_frequencies(store, small(seen.select("term").distinct(), bounded), buckets)
    return heaviest(seen, df, corpus_counts(store)[0], n_terms)


def refine_from_store(store: ArchiveStore, queries: DataFrame, n_docs: int = 5, n_terms: int = 5) -> DataFrame:
    """Queries with feedback words appended in weight order; unchanged where nothing was found. Kept, as searches read it several times."""
    return durable(with_added(queries, feedback_of_store(store, queries, n_docs, n_terms)))
