"""Capture filters: missing windows, excluded titles, repeated seconds, unchanged frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.keys import capture_key, exclusion_terms
from daybook.operators.slices import SLICE_SECONDS, with_previous
from daybook.runtime import broadcast_if_small

INLINE_TERMS = 64
RUN = 3


def with_window(captures: DataFrame) -> DataFrame:
    """Captures with a window id and a title."""
    return captures.filter((F.length("window_id") > 0) & (F.length("title") > 0))


def _runs(text: Column, n: int) -> Column:
    """All runs of n characters."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(n)))


def exclude_titles(captures: DataFrame, terms: str | list[str] | DataFrame) -> DataFrame:
    """Drop captures whose lower-cased title contains any term.

    `terms` is a list (or comma-separated text), or for long lists a table with a column
    `term`. The table meets each distinct title once, by a join on character runs: a term can
    only be inside a title that holds the term's first three characters.
    """
    if not isinstance(terms, DataFrame):
        wanted = exclusion_terms(terms)
        if not wanted:
            return captures
        if len(wanted) <= INLINE_TERMS:
            hit = reduce(lambda a, b: a | b, [F.lower("title").contains(t) for t in wanted])
            return captures.filter(~F.coalesce(hit, F.lit(False)))
        terms = captures.sparkSession.createDataFrame([(t,) for t in wanted], "term string")
    clean = terms.select(F.lower(F.btrim("term")).alias("term")).filter(F.length("term") > 0).distinct()
    keyed = clean.withColumn("_run", F.substring("term", 1, RUN))
    titles = captures.select("title").distinct().withColumn("_low", F.lower("title"))
    runs = F.array_distinct(F.concat(*[_runs(F.col("_low"), n) for n in range(1, RUN + 1)]))
    met = titles.filter(F.length("_low") > 0).withColumn("_run", F.explode(runs))
    blocked = (
        met.join(broadcast_if_small(keyed, 100_000), "_run")
        .filter(F.col("_low").contains(F.col("term")))
        .select("title")
        .distinct()
    )
    return captures.join(blocked, "title", "left_anti")


def first_per_key(captures: DataFrame) -> DataFrame:
    """The first capture of each window and second (a key has one-second resolution).

    Spark cuts each map task to one row per key before the shuffle (window group limit).
    """
    w = Window.partitionBy("window_id", F.unix_seconds("ts")).orderBy("ts", "seq")
    return captures.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def drop_unchanged(captures: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Per window, drop frames equal to the frame before.

    Equality is transitive, so this is the same as comparing with the last kept frame. After
    `first_per_key` one window has at most `slice_seconds` rows in a slice.
    """
    rows = with_previous(
        first_per_key(captures), ["window_id"], ["ts", "seq"], F.col("frame_hash"), "last_hash", slice_seconds
    )
    kept = rows.filter(~F.col("has_last_hash") | ~F.col("frame_hash").eqNullSafe(F.col("last_hash")))
    return kept.drop("last_hash", "has_last_hash")


def frames_without_text(frames: DataFrame, docs: DataFrame) -> DataFrame:
    """Kept frames for which no text exists, by capture key."""
    keyed = frames.withColumn("_key", capture_key(F.col("window_id"), F.col("ts")))
    return keyed.join(docs.select(F.col("path").alias("_key")), "_key", "left_anti").drop("_key")
