"""Greedy throttle: let the first event through, then nothing until more than `interval` has passed.

Each emission depends on the one before it, yet no key has to be one task:
1. A gap longer than the interval always re-opens the gate, so a key falls into bursts whose
   first event is emitted and whose first interval is silent. Spark windows settle these.
2. What is left of long bursts is cut into slices. Per slice, Python tabulates the last emission
   as a step function of the last emission before the slice.
3. The step functions (one short row per slice) are folded along each burst.
4. Every slice then replays from its known entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.slices import SLICE_SECONDS, slice_of, with_previous
from daybook.runtime import durable

SLICE_INTERVALS = 100


def _last_reached(t: np.ndarray, interval: int) -> np.ndarray:
    """Index of the last emission of the slice for every possible first emission."""
    nxt = np.searchsorted(t, t + interval, side="right")
    at = np.where(nxt == len(t), np.arange(len(t)), np.minimum(nxt, len(t) - 1))
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return at
        at = further


def _bursts(rows: DataFrame, keys: list[str], interval: int, seconds: int) -> DataFrame:
    """Add `_open` (burst start) and `_burst` (instant of the burst start), in microseconds."""
    seen = with_previous(rows, keys, ["_us_ts", "seq"], F.col("_us"), "prev", seconds)
    seen = seen.withColumn("_open", ~F.col("has_prev") | (F.col("_us") - F.col("prev") > interval))
    seen = seen.withColumn("_start", F.when(F.col("_open"), F.col("_us"))).drop("prev", "has_prev")
    seen = seen.withColumn("_slice", slice_of(F.col("_us_ts"), seconds))
    starts = seen.groupBy(*keys, "_slice").agg(F.max("_start").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = starts.select(*keys, "_slice", F.max("_s").over(before).alias("_s_in"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_us").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        seen.join(carry, [*keys, "_slice"])
        .withColumn("_burst", F.greatest(F.max("_start").over(inside), F.col("_s_in")))
        .drop("_slice", "_s_in", "_start")
    )


def throttle(
    events: DataFrame,
    keys: list[str],
    interval_seconds: float = 60,
    slice_seconds: int = SLICE_SECONDS,
    slice_intervals: int = SLICE_INTERVALS,
) -> DataFrame:
    """Emitted rows of `events` (columns `ts`, `seq` and the keys, which must not be NULL)."""
    interval = int(interval_seconds * 1_000_000)
    width = interval * slice_intervals
    narrow = events.select(*keys, "seq", F.unix_micros("ts").alias("_us"), F.col("ts").alias("_us_ts"))
    first = Window.partitionBy(*keys, "_us").orderBy("seq")
    narrow = narrow.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    rows = durable(_bursts(narrow, keys, interval, slice_seconds))

    settled = rows.filter("_open").select(*keys, "_us", "seq")
    rest = rows.filter(F.col("_us") > F.col("_burst") + interval).withColumn(
        "_part", F.floor((F.col("_us") - F.col("_burst")) / F.lit(width))
    )
    part_keys = [*keys, "_burst", "_part"]
    key_types = {f.name: f.dataType.simpleString() for f in rest.schema}
    ddl = ", ".join(f"`{c}` {key_types[c]}" for c in part_keys)
    out_cols = [*keys, "_us", "seq"]

    def tabulate(key: tuple, rows: pa.Table) -> pa.Table:
        t = np.sort(rows["_us"].to_numpy())
        begin = key[-2].as_py() + key[-1].as_py() * width
        reachable = np.searchsorted(t, begin + interval, side="right") + 1
        ends = t[_last_reached(t, interval)][:reachable]
        entries = t[: len(ends)]
        last_of_run = np.append(ends[1:] != ends[:-1], True)
        keyed = rows.select(part_keys).slice(0, 1)
        keyed = keyed.append_column("entries", pa.array([entries[last_of_run]]))
        return keyed.append_column("ends", pa.array([ends[last_of_run]]))

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_part")
        last, entered = key[-1].as_py(), []
        for entries, ends in zip(rows["entries"], rows["ends"]):
            entered.append(last)
            i = np.searchsorted(entries.values.to_numpy(), last + interval, side="right")
            if i < len(ends.values):
                last = ends.values[int(i)].as_py()
        return rows.select(part_keys).append_column("_in", pa.array(entered, pa.int64()))

    def replay(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_us")
        t, last, hit = rows["_us"].to_numpy(), rows["_in"][0].as_py(), []
        i = int(np.searchsorted(t, last + interval, side="right"))
        while i < len(t):
            hit.append(i)
            i = int(np.searchsorted(t, t[i] + interval, side="right"))
        return rows.select(out_cols).take(pa.array(hit, pa.int64()))

    steps = rest.groupBy(*part_keys).applyInArrow(tabulate, f"{ddl}, entries array<bigint>, ends array<bigint>")
    entry = steps.groupBy(*keys, "_burst").applyInArrow(fold, f"{ddl}, _in bigint")
    cut = rest.select(*part_keys, "_us", "seq").join(entry, part_keys)
    replayed = cut.groupBy(*part_keys).applyInArrow(replay, ", ".join(f"`{c}` {key_types[c]}" for c in out_cols))
    emitted = settled.unionByName(replayed)
    return (
        events.withColumn("_us", F.unix_micros("ts")).join(emitted, [*keys, "_us", "seq"], "left_semi").drop("_us")
    )
