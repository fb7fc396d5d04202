"""Positions and running sums over an order, without a global sort: buckets in order, then offsets from bucket totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    rows: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Add `name`: the sum of `value` over all earlier rows of the same keys, in the order of `bucket` and then `order`.

    `bucket` must not contradict `order` between rows. Each task sorts single buckets; totals of buckets (one short row per key and
    bucket) give the offsets. `rows` is read twice, so it should be durable. Null keys form a group of their own.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    offsets = totals.select(
        *(F.col(k).alias(f"_{k}") for k in keys), F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    same = F.col(bucket).eqNullSafe(F.col("_bucket"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    part = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return part.join(offsets, same).withColumn(name, F.col("_inside") + F.col("_before")).drop(
        "_inside", "_before", "_bucket", *(f"_{k}" for k in keys)
    )
