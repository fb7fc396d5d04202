"""Streaming twins of the capture operators. Rows of a key must arrive in time order across
micro-batches; inside one micro-batch they are sorted here. The size of a micro-batch, and so
of a key's share in it, is bounded by the source's trigger options."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from daybook.operators.captures import exclude_titles, with_window
from daybook.runtime import make_dir
from daybook.sources.feeds import stream_table

NEVER = -(1 << 62)
#: State of a key without rows for this long (in the rows' own time) is dropped: the default retention. Rows older than that are not taken.
IDLE_DAYS = 90
#: Groups that hold the state of all keys. Each call into Python costs far more than the few rows that a key brings, so a call serves many keys.
GROUPS = 1024


def _ordered(chunks: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(chunks), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


def in_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add `in_key`, one text per key (nulls are a key), and `in_group`, the number of the group that holds the key's state."""
    return df.withColumn("in_key", F.to_json(F.struct(*keys))).withColumn("in_group", F.pmod(F.xxhash64("in_key"), F.lit(GROUPS)))


def spans_of(keys: np.ndarray) -> list[tuple[str, int, int]]:
    """(key, first row, row after the last) of each key in rows sorted by key."""
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [(keys[low], low, high) for low, high in zip(cuts, cuts[1:])]


def micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype("int64")


def _stateful(df: DataFrame, keys: list[str], order: list[str], judge, state: str, out: T.StructType) -> DataFrame:
    """Judge each key's rows, in `order`, by state that ends when the stream's time is IDLE_DAYS past the key's last row.

    `judge(rows, spans, before)` gets rows of several keys, sorted, with their spans and states (None for a new key), and returns which rows leave,
    which of these are late, and the states after.
    """
    held_as = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("until", T.ArrayType(T.LongType()))])
    for f in T.StructType.fromDDL(state):
        held_as.add(f.name, T.ArrayType(f.dataType))

    def step(_: tuple, chunks: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = {key: rest for key, *rest in zip(*group.get)} if group.exists else {}
        now = group.getCurrentWatermarkMs()
        rows = None if group.hasTimedOut else _ordered(chunks, ["in_key", *order])
        spans = [] if rows is None else spans_of(rows["in_key"].to_numpy())
        before = [tuple(held[key][1:]) if key in held else None for key, _, _ in spans]
        # A key whose time is up goes, unless rows of it are here.
        held = {key: rest for key, rest in held.items() if rest[0] >= now}
        if spans:
            leaving, late, after = judge(rows, spans, before)
            t = micros(rows["ts"])
            for (key, low, high), kept in zip(spans, after):
                if kept is not None:
                    held[key] = [max(int(t[low:high].max()) // 1000 + 1, now + 1), *kept]
            if leaving.any():
                yield rows[leaving].assign(late=late[leaving])[out.fieldNames()]
        if not held:
            group.remove()
            return
        group.update((list(held), *map(list, zip(*held.values()))))
        group.setTimeoutTimestamp(max(min(rest[0] for rest in held.values()), now + 1))

    grouped = in_groups(df.withWatermark("ts", f"{IDLE_DAYS} days"), keys).groupBy("in_group")
    return grouped.applyInPandasWithState(step, out, held_as, "append", GroupStateTimeout.EventTimeTimeout)


def gate_rows(
    t: np.ndarray, side: np.ndarray, kind: np.ndarray, active: np.ndarray, before: tuple, pause_on_suspend: bool, pause_when_locked: bool
) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Judge a session's rows, in order, by its suspend and lock flags: (passed captures, captures that came too late, flags after).

    `before` and the flags after are (suspended, since, locked, since) in microseconds, as `t`. `side` is 0 for a state, 1 for a capture.
    """
    flags, after = [], []
    for name, old, since in zip(("suspend", "lock"), before[::2], before[1::2]):
        # Position of the newest state of this kind at each row; 0 stands for the state kept from before.
        at = np.maximum.accumulate(np.where((side == 0) & (kind == name) & (t >= since), np.arange(1, len(t) + 1), 0))
        flags.append(np.concatenate([[bool(old)], active])[at])
        after += [bool(flags[-1][-1]), int(np.concatenate([[since], t])[at[-1]])]
    late = (side == 1) & (t < max(before[1], before[3]))
    open_ = (side == 1) & ~late & ~(flags[0] & pause_on_suspend) & ~(flags[1] & pause_when_locked)
    return open_, late, tuple(after)


def gate_spans(rows: pd.DataFrame, spans: list, before: list[tuple | None], pause_on_suspend: bool, pause_when_locked: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """`gate_rows` for the sessions of some sorted rows."""
    t, side, kind = micros(rows["ts"]), rows["_side"].to_numpy(), rows["_kind"].to_numpy()
    active = rows["_active"].astype(object).where(rows["_active"].notna(), False).to_numpy().astype(bool)
    open_, late, after = np.zeros(len(rows), bool), np.zeros(len(rows), bool), []
    for (_, low, high), old in zip(spans, before):
        at = slice(low, high)
        open_[at], late[at], flags = gate_rows(t[at], side[at], kind[at], active[at], old or (False, NEVER, False, NEVER), pause_on_suspend, pause_when_locked)
        after.append(flags)
    return open_, late, after


def changed_rows(seconds: np.ndarray, hashes: list, last: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """Judge a window's captures, in order: (kept, too late, (hash, second) after).

    The first capture of each second counts, and is kept if its frame differs from the one before.
    """
    last_hash, last_second = last if last is not None else (object(), NEVER)
    late = seconds < last_second
    kept = np.zeros(len(seconds), bool)
    after = last
    for i in np.nonzero(~late)[0].tolist():
        if seconds[i] > last_second:
            kept[i] = hashes[i] != last_hash
            last_hash, last_second = after = (hashes[i], int(seconds[i]))
    return kept, late, after


def drop_unchanged_stream(captures: DataFrame) -> DataFrame:
    """First capture per window and second, then drop frames equal to the window's last one.

    State per window: hash and second of its last capture. Captures older than the state are
    emitted with `late` = true for a side output and never compared.
    """
    out = T.StructType([*captures.schema.fields, T.StructField("late", T.BooleanType())])

    def judge(rows: pd.DataFrame, spans: list, before: list) -> tuple[np.ndarray, np.ndarray, list]:
        second = rows["ts"].to_numpy().astype("datetime64[s]").astype("int64")
        hashes = rows["frame_hash"].astype(object).where(rows["frame_hash"].notna(), None).tolist()
        kept, late, after = np.zeros(len(rows), bool), np.zeros(len(rows), bool), []
        for (_, low, high), last in zip(spans, before):
            kept[low:high], late[low:high], now = changed_rows(second[low:high], hashes[low:high], last)
            after.append(now)
        return kept | late, late, after

    return _stateful(captures, ["window_id"], ["ts", "seq"], judge, "last_hash string, last_second long", out)


def gate_stream(captures: DataFrame, states: DataFrame, pause_on_suspend=True, pause_when_locked=True) -> DataFrame:
    """Pass captures taken while their session is neither suspended nor locked.

    Both streams feed one state per session: the newest suspend and lock flags with their times. A state that is older than the newest
    one of its kind changes nothing. A capture that is older than a state of an earlier micro-batch cannot be judged any more:
    it is emitted with `late` = true for a side output, whatever the flags.
    """
    cols = captures.columns
    left = captures.select(
        "session", "ts", "seq", F.lit(1).alias("_side"), F.lit("").alias("_kind"), F.lit(False).alias("_active"),
        F.struct(*cols).alias("_row"),
    )
    right = states.select(
        "session", "ts", "seq", F.lit(0).alias("_side"), F.col("kind").alias("_kind"), F.col("active").alias("_active"),
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
    )
    both = left.unionByName(right)
    out = T.StructType([both.schema["_row"], T.StructField("late", T.BooleanType())])

    def judge(rows: pd.DataFrame, spans: list, before: list) -> tuple[np.ndarray, np.ndarray, list]:
        open_, late, after = gate_spans(rows, spans, before, pause_on_suspend, pause_when_locked)
        return open_ | late, late, after

    names = "suspended boolean, suspended_at long, locked boolean, locked_at long"
    return _stateful(both, ["session"], ["ts", "_side", "seq"], judge, names, out).select("_row.*", "late")


def throttle_stream(events: DataFrame, keys: list[str], interval_seconds: float = 60) -> DataFrame:
    """Emit an event, then nothing of its key until more than the interval has passed.

    An event older than the newest one of an earlier micro-batch comes too late to be weighed against what was emitted; it is emitted
    with `late` = true for a side output.
    """
    interval = int(interval_seconds * 1_000_000)
    out = T.StructType([*events.schema.fields, T.StructField("late", T.BooleanType())])

    def judge(rows: pd.DataFrame, spans: list, before: list) -> tuple[np.ndarray, np.ndarray, list]:
        times, leaving, late, after = micros(rows["ts"]), np.zeros(len(rows), bool), np.zeros(len(rows), bool), []
        for (_, low, high), old in zip(spans, before):
            t = times[low:high]
            last, newest = old or (NEVER, NEVER)
            n_late = int(np.searchsorted(t, newest))
            leaving[low : low + n_late] = late[low : low + n_late] = True
            i = max(n_late, int(np.searchsorted(t, last + interval, side="right")))
            while i < len(t):
                leaving[low + i] = True
                last = int(t[i])
                i = int(np.searchsorted(t, last + interval, side="right"))
            after.append((last, max(newest, int(t[-1]))))
        return leaving, late, after

    return _stateful(events, keys, ["ts", "seq"], judge, "last_emit long, newest long", out)


def ingest(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> DataStreamWriter:
    """Write a stream as Parquet; without `every` it drains what is there and stops."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def frame_streams(
    captures: DataFrame,
    states: DataFrame,
    root: str,
    excluded: str | list[str] = "",
    every: str | None = None,
    files_per_trigger: int = 1000,
    **gates: bool,
) -> list[DataStreamWriter]:
    """Frames kept by the ingest pipeline, as two streams to be started in this order; `ingest.capture_stream` goes on to texts in one.

    The first applies the gates and drops missing windows and excluded titles; the second reads
    what it wrote to `root/gated`, drops unchanged frames and writes `root/kept`. Both keep
    state, and Spark allows one such operator per stream. A window belongs to one session, so
    one file holds all its captures of a micro-batch and their order survives. Captures that came too late for the gate stay in
    `root/gated` with `late_gate` = true.
    """
    gated = exclude_titles(with_window(gate_stream(captures, states, **gates)), excluded).withColumnRenamed("late", "late_gate")
    first = ingest(gated, f"{root}/gated", f"{root}/checkpoints/gated", every)
    make_dir(captures.sparkSession, f"{root}/gated")
    arriving = stream_table(captures.sparkSession, f"{root}/gated", gated.schema, files_per_trigger)
    judged = arriving.filter("NOT late_gate").drop("late_gate")
    second = ingest(drop_unchanged_stream(judged), f"{root}/kept", f"{root}/checkpoints/kept", every)
    return [first, second]
