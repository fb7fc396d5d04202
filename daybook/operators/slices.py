"""Neighbouring rows of a key in time order, with hot keys cut into time slices.

A window over a whole key puts a busy key into one task. Here every (key, slice) is its own
window group; the value at a slice edge comes from a summary with one row per key and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 3600


def slice_of(ts: Column, seconds: int = SLICE_SECONDS) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def _with_neighbour(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, seconds: int, step: int
) -> DataFrame:
    pick = F.max_by if step < 0 else F.min_by
    move = F.lag if step < 0 else F.lead
    rows = df.withColumn("_slice", slice_of(F.col(order[0]), seconds)).withColumn("_v", F.struct(value.alias("v")))
    edges = rows.groupBy(*keys, "_slice").agg(pick("_v", F.struct(*order)).alias("_edge"))
    carry = edges.select(
        *keys, "_slice", move("_edge").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry")
    )
    inside = move("_v").over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    return (
        rows.join(carry, [*keys, "_slice"])
        .withColumn("_n", F.coalesce(inside, F.col("_carry")))
        .withColumn(name, F.col("_n.v"))
        .withColumn(f"has_{name}", F.col("_n").isNotNull())
        .drop("_slice", "_v", "_carry", "_n")
    )


def with_previous(df, keys, order, value, name="previous", seconds=SLICE_SECONDS) -> DataFrame:
    """Value of the row before, per key; `has_<name>` is false on a key's first row.

    `order[0]` is the instant; keys must not be NULL.
    """
    return _with_neighbour(df, keys, order, value, name, seconds, -1)


def with_following(df, keys, order, value, name="following", seconds=SLICE_SECONDS) -> DataFrame:
    """Value of the row after, per key; `has_<name>` is false on a key's last row."""
    return _with_neighbour(df, keys, order, value, name, seconds, 1)
