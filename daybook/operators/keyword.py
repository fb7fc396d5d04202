"""Keyword retrieval on postings: all, any, none and phrase matches, and BM25 ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.text import tokens
from daybook.runtime import broadcast_if_small, durable, fits, small, stored

K1 = 1.2
B = 0.75
QUERY_TERM_ROWS = 1_000_000
#: Postings that one task of `match_any` takes, each of which stands for many queries.
TASK_POSTINGS = 200_000


def query_terms(queries: DataFrame, fold: bool = False) -> DataFrame:
    """(query_id, term, offset, n_terms): the distinct words of each query, first offset kept."""
    words = queries.select("query_id", tokens(F.col("text"), fold).alias("_w"))
    words = words.select("query_id", F.size(F.array_distinct("_w")).alias("n_terms"), F.posexplode("_w"))
    return words.groupBy("query_id", F.col("col").alias("term")).agg(
        F.min("pos").alias("offset"), F.first("n_terms").alias("n_terms")
    )


def postings_match(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the query terms only, still one row per term and document.

    The term side is broadcast after its size is checked; otherwise the join shuffles.
    """
    wanted = broadcast_if_small(terms.select("term").distinct(), QUERY_TERM_ROWS)
    return postings.join(wanted, "term", "left_semi")


def with_df(terms: DataFrame, found: DataFrame) -> DataFrame:
    """Add each term's document frequency. The result is as small as the queries and is kept,
    so that the postings are counted once."""
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return durable(terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))))


def of_paths(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen documents, cut before anything is shuffled where these are few."""
    return rows.join(broadcast_if_small(durable(chosen.select("path").distinct()), QUERY_TERM_ROWS), "path", "left_semi")


def rarest_first(found: DataFrame, sized: DataFrame) -> DataFrame:
    """(query_id, path) of documents that hold all terms of a query; `sized` comes from `with_df`.

    A match must hold the query's rarest term, so candidates come from that term's postings
    and only they are looked up under the other terms. A word found everywhere costs no more
    than the rarest word beside it.
    """
    bounded = fits(sized, QUERY_TERM_ROWS)
    order = Window.partitionBy("query_id").orderBy("df", "term")
    ordered = sized.withColumn("_n", F.row_number().over(order))
    lead = ordered.filter("_n = 1 AND df > 0").select("query_id", "term", "n_terms")
    others = ordered.filter("_n > 1").select("query_id", F.col("term").alias("other"))
    candidates = durable(found.select("term", "path").join(small(lead, bounded), "term").select("query_id", "path", "n_terms"))
    alone = candidates.filter("n_terms = 1").select("query_id", "path")
    probes = candidates.filter("n_terms > 1").join(small(others, bounded), "query_id")
    held = probes.join(
        of_paths(found.select(F.col("term").alias("other"), "path"), candidates), ["other", "path"]
    ).groupBy("query_id", "path").agg(F.count(F.lit(1)).alias("_held"), F.first("n_terms").alias("n_terms"))
    return alone.unionByName(held.filter("_held = n_terms - 1").select("query_id", "path"))


def match_all(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents with all terms. The query terms' postings are read several times, hence kept."""
    found = durable(postings_match(postings.select("term", "path"), terms))
    return rarest_first(found, with_df(terms, found))


def by_document(found: DataFrame) -> DataFrame:
    """Postings of query terms dealt by document, so that what is found for a document is put together without another shuffle.

    The number of tasks follows from the number of postings: a posting of a few bytes stands for all queries with its term,
    so tasks sized by bytes would grow with the number of queries.
    """
    tasks = max(found.sparkSession.sparkContext.defaultParallelism, -(-found.count() // TASK_POSTINGS))
    return found.repartition(tasks, "path")


def match_any(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents with any of the terms. A document's postings are in one task, so only postings are shuffled, not the hits of each term."""
    wanted = broadcast_if_small(terms.select("query_id", "term"), QUERY_TERM_ROWS)
    found = by_document(durable(postings_match(postings.select("term", "path"), terms)))
    return found.join(wanted, "term").select("query_id", "path").distinct()


def match_without(postings: DataFrame, terms: DataFrame, barred: DataFrame) -> DataFrame:
    """Documents with any of the terms and none of the query's barred ones, in one pass over the postings of a document."""
    sides = terms.select("query_id", "term", F.lit(True).alias("wanted")).unionByName(barred.select("query_id", "term", F.lit(False).alias("wanted")))
    sides = durable(sides)
    found = by_document(durable(postings_match(postings.select("term", "path"), sides)))
    held = found.join(broadcast_if_small(sides, QUERY_TERM_ROWS), "term").groupBy("query_id", "path")
    # A null query or path equals none, so no barred word is found for it.
    held = held.agg(F.min("wanted").alias("clean"), F.max("wanted").alias("hit"))
    return held.filter("hit AND (clean OR query_id IS NULL OR path IS NULL)").select("query_id", "path")


def match_phrase(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents that hold the query's words as consecutive words in that order.

    Each word's positions, moved back by its offset, are possible starts of the phrase; a match
    has a start common to all words. One row per query word and document is grouped.
    """
    words = queries.select("query_id", tokens(F.col("text")).alias("_w"))
    slots = words.select("query_id", F.posexplode("_w").alias("offset", "term"))
    distinct = slots.select("query_id", "term").distinct().withColumn("offset", F.lit(0))
    counts = distinct.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    found = durable(postings_match(postings, slots))
    both = rarest_first(found, with_df(distinct.join(counts, "query_id"), found))
    bounded = fits(slots, QUERY_TERM_ROWS)
    begins = F.transform("positions", lambda p: p - F.col("offset"))
    slotted = (
        both.join(small(slots, bounded), "query_id")
        .join(found.select("term", "path", "positions"), ["term", "path"])
        .groupBy("query_id", "path")
        .agg(F.collect_list(begins).alias("_b"))
    )
    common = F.reduce(F.slice("_b", F.lit(2), F.size("_b")), F.col("_b")[0], F.array_intersect)
    return slotted.filter(F.size(common) > 0).select("query_id", "path")


def keyword_match(postings: DataFrame, queries: DataFrame, mode: str = "all", without: DataFrame | None = None) -> DataFrame:
    """(query_id, path) of matching documents.

    `mode` is all, any or phrase. `without` (query_id, text) removes documents that hold any
    of its words, which is how a query excludes words.
    """
    if mode == "any" and without is not None:
        return match_without(postings, query_terms(queries), query_terms(without))
    if mode == "phrase":
        hits = match_phrase(postings, queries)
    elif mode in ("all", "any"):
        hits = (match_all if mode == "all" else match_any)(postings, query_terms(queries))
    else:
        raise ValueError(f"unknown mode: {mode}")
    if without is None:
        return hits
    terms = broadcast_if_small(query_terms(without).select("query_id", "term"), QUERY_TERM_ROWS)
    barred = (
        postings.join(terms, "term").select("query_id", "path").join(hits, ["query_id", "path"], "left_semi")
    )
    return hits.join(barred, ["query_id", "path"], "left_anti")


def bm25(tf: Column, df: Column, length: Column, n_docs: Column, avg_len: Column) -> Column:
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def keyword_search(
    postings: DataFrame,
    stats: DataFrame,
    queries: DataFrame,
    k: int = 10,
    mode: str = "all",
    optional: DataFrame | None = None,
) -> DataFrame:
    """Top `k` documents per query by BM25: (query_id, rank, path, score), ties by path.

    `stats` has (path, len) for the whole corpus. `optional` (query_id, text) adds words that
    raise the score but are not required. Scores are rounded to 6 digits before ranking. The
    postings of the query terms are stored, because ranking reads them several times.
    """
    terms = query_terms(queries).select("query_id", "term", "n_terms")
    if optional is not None:
        extra = query_terms(optional).select("query_id", "term", F.lit(None).cast("int").alias("n_terms"))
        terms = terms.unionByName(extra).groupBy("query_id", "term").agg(F.max("n_terms").alias("n_terms"))
    corpus = stats.agg(F.struct(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))).scalar()
    found = stored(postings_match(postings.select("term", "path", "tf"), terms), "found")
    sized = with_df(terms, found)
    stats = stats.select("path", "len")
    weighted = small(sized.filter("df > 0").select("query_id", "term", "df"), fits(sized, QUERY_TERM_ROWS))
    if mode == "any":
        rows = found.join(weighted, "term")
    else:
        hits = durable(rarest_first(found, sized.filter(F.col("n_terms").isNotNull())))
        stats = of_paths(stats, hits)
        rows = hits.join(weighted, "query_id").join(of_paths(found, hits), ["term", "path"])
    rows = rows.join(stats, "path")
    part = bm25(F.col("tf"), F.col("df"), F.col("len"), corpus["n_docs"], corpus["avg_len"])
    scores = rows.groupBy("query_id", "path").agg(F.round(F.sum(part), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
