"""Query refinement: a pluggable model, a synonym table, or feedback from the top documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.keyword import QUERY_TERM_ROWS, keyword_search, postings_match, query_terms
from daybook.runtime import broadcast_if_small, durable, fits, small


def refine_with(queries: DataFrame, refine: Callable[[str], str] | None) -> DataFrame:
    """Replace each text by `refine(text)`; without a refiner, or where it fails, keep the text."""
    if refine is None:
        return queries

    def attempt(text: str) -> str:
        try:
            return refine(text).strip()
        except Exception:  # noqa: BLE001 - a failing model must not fail the search
            return text

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(attempt)

    return queries.withColumn("text", run("text"))


def expand_synonyms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Append the synonyms (term, synonym) of a query's words, each once, in alphabetical order."""
    terms = query_terms(queries).select("query_id", "term")
    extra = (
        terms.join(broadcast_if_small(synonyms, QUERY_TERM_ROWS), "term")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set("synonym")).alias("_extra"))
    )
    added = F.concat_ws(" ", F.col("text"), F.array_join("_extra", " "))
    return queries.join(extra, "query_id", "left").select("query_id", F.coalesce(added, "text").alias("text"))


def feedback_terms(
    postings: DataFrame, stats: DataFrame, queries: DataFrame, n_docs: int = 5, n_terms: int = 5
) -> DataFrame:
    """(query_id, term, weight): words most typical of a query's top documents.

    Weight is the sum over those documents of tf / length, times the word's idf. Only the
    postings of the top documents are aggregated, at most n_docs documents per query.
    """
    top = durable(keyword_search(postings, stats, queries, n_docs).select("query_id", "path"))
    corpus = stats.agg(F.count(F.lit(1))).scalar()
    bounded = fits(top, QUERY_TERM_ROWS)
    paths = small(top.select("path").distinct(), bounded)
    here = lambda df: df.join(paths, "path", "left_semi")  # noqa: E731 - pushed below grouping
    seen = (
        here(postings.select("term", "path", "tf"))
        .join(small(top, bounded), "path")
        .join(here(stats.select("path", "len")), "path")
        .groupBy("query_id", "term")
        .agg(F.sum(F.col("tf") / F.col("len")).alias("_w"))
    )
    seen = durable(seen.join(query_terms(queries).select("query_id", "term"), ["query_id", "term"], "left_anti"))
    df = postings_match(postings.select("term", "path"), seen).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return heaviest(seen, df, corpus, n_terms)


def heaviest(seen: DataFrame, df: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(query_id, term, weight): the best words of `seen` (query_id, term, _w) by weight times idf; `df` has (term, df)."""
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = seen.join(df, "term").select("query_id", "term", F.round(F.col("_w") * idf, 6).alias("weight"))
    best = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "term")
    return weighted.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= n_terms).drop("_n")


def refine_queries(
    postings: DataFrame, stats: DataFrame, queries: DataFrame, n_docs: int = 5, n_terms: int = 5
) -> DataFrame:
    """Queries with feedback words appended in weight order; unchanged where nothing was found.

    The result has one row per query and is checkpointed, so later steps never repeat the search.
    """
    return durable(with_added(queries, feedback_terms(postings, stats, queries, n_docs, n_terms)))


def with_added(queries: DataFrame, weighted: DataFrame) -> DataFrame:
    """Queries with the words of `weighted` (query_id, term, weight) appended, heaviest first."""
    extra = weighted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))).alias("_t"))
    added = F.concat_ws(" ", F.col("text"), F.array_join(F.transform("_t", lambda x: x["term"]), " "))
    return queries.join(extra, "query_id", "left").select("query_id", F.coalesce(added, "text").alias("text"))
