"""Lock and suspend signals: as-of state, gates, transitions, paused intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.slices import SLICE_SECONDS, slice_of, with_following, with_previous

KINDS = ("suspend", "lock")


def asof_state(
    captures: DataFrame,
    states: DataFrame,
    kinds: tuple[str, ...] = KINDS,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Add `<kind>_active`: the newest state of the capture's session at or before its instant.

    NULL where no state is known. Captures and states of one session meet in time slices; a
    summary with one row per session and slice carries the state into each slice.
    """
    cols = captures.columns
    known = states.filter(F.col("session").isNotNull() & F.col("kind").isin(*kinds))
    left = captures.select(
        F.col("session").alias("_session"),
        F.col("ts").alias("_ts"),
        F.lit(1).alias("_side"),
        F.lit(None).cast("long").alias("_seq"),
        F.struct(*cols).alias("_row"),
        *[F.lit(None).cast("boolean").alias(f"_{k}") for k in kinds],
    )
    right = known.select(
        F.col("session").alias("_session"),
        F.col("ts").alias("_ts"),
        F.lit(0).alias("_side"),
        F.col("seq").alias("_seq"),
        *[F.when(F.col("kind") == k, F.col("active")).alias(f"_{k}") for k in kinds],
    )
    cut = lambda d: d.withColumn("_slice", slice_of(F.col("_ts"), slice_seconds))
    left, right = cut(left), cut(right)
    both = left.unionByName(right, allowMissingColumns=True)

    at = F.struct("_ts", "_seq")
    last = [
        F.max_by(f"_{k}", F.when(F.col(f"_{k}").isNotNull(), at)).alias(f"_{k}") for k in kinds
    ]
    edges = right.groupBy("_session", "_slice").agg(*last).unionByName(
        left.select("_session", "_slice").distinct(), allowMissingColumns=True
    )
    edges = edges.groupBy("_session", "_slice").agg(*[F.bool_or(f"_{k}").alias(f"_{k}") for k in kinds])
    before = Window.partitionBy("_session").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(
        "_session", "_slice", *[F.last(f"_{k}", ignorenulls=True).over(before).alias(f"_{k}_in") for k in kinds]
    )
    inside = (
        Window.partitionBy("_session", "_slice")
        .orderBy("_ts", "_side", "_seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = both.join(carry, ["_session", "_slice"], "left")
    out = joined.select(
        "_side",
        "_row",
        *[
            F.coalesce(F.last(f"_{k}", ignorenulls=True).over(inside), F.col(f"_{k}_in")).alias(f"{k}_active")
            for k in kinds
        ],
    )
    return out.filter("_side = 1").select("_row.*", *[f"{k}_active" for k in kinds])


def paused_reason(captures: DataFrame, states: DataFrame, pause_on_suspend=True, pause_when_locked=True) -> DataFrame:
    """Add `drop_reason`: `suspended`, else `locked`, else NULL. Unknown state is not paused."""
    seen = asof_state(captures, states)
    reason = F.when(F.lit(pause_on_suspend) & F.coalesce("suspend_active", F.lit(False)), F.lit("suspended")).when(
        F.lit(pause_when_locked) & F.coalesce("lock_active", F.lit(False)), F.lit("locked")
    )
    return seen.withColumn("drop_reason", reason).drop("suspend_active", "lock_active")


def gate_paused(captures: DataFrame, states: DataFrame, pause_on_suspend=True, pause_when_locked=True) -> DataFrame:
    """Captures taken while neither suspended nor locked."""
    return (
        paused_reason(captures, states, pause_on_suspend, pause_when_locked)
        .filter(F.col("drop_reason").isNull())
        .drop("drop_reason")
    )


def state_transitions(states: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Signals that change the state of a session and kind; the state before the first is false."""
    rows = with_previous(
        states, ["session", "kind"], ["ts", "seq"], F.col("active"), "was", slice_seconds
    )
    changed = F.col("active") != F.coalesce("was", F.lit(False))
    return rows.filter(changed).drop("was", "has_was")


def pause_intervals(states: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Paused spans (session, kind, start_ts, end_ts); end_ts is NULL while still open."""
    changes = state_transitions(states, slice_seconds)
    spans = with_following(changes, ["session", "kind"], ["ts", "seq"], F.col("ts"), "end_ts", slice_seconds)
    return spans.filter("active").select("session", "kind", F.col("ts").alias("start_ts"), "end_ts")
