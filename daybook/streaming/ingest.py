"""Captures to stored texts in one streaming query: gates, unchanged frames, extraction, an idempotent sink.

One stateful operator keeps, for many sessions at a time, the suspend and lock flags in one state variable and, per session and window, the last frame's hash and second in
another; both expire when they have not been touched for the retention time. Each micro-batch of kept frames is turned into texts and written
as one batch of the store's `texts`, under a number reserved for it, so a repeated micro-batch finds its batch written and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from daybook.functions.keys import capture_key
from daybook.operators.captures import exclude_titles, with_window
from daybook.schemas import DOCS
from daybook.schemas import stored as stored_schema
from daybook.sources.files import texts_to_write
from daybook.sources.store import ArchiveStore
from daybook.streaming.captures import IDLE_DAYS, changed_rows, gate_spans, in_groups, spans_of
from daybook.streaming.index import stream_id

FLAGS = "suspended boolean, suspended_at long, locked boolean, locked_at long"
#: State of this kind is kept by the provider that can hold several variables per key.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

JUDGED = ["session", "ts", "seq", "_side", "_kind", "_active", "_window", "_hash", "_row", "in_key", "in_group"]

Extract = Callable[[DataFrame], DataFrame]


class CaptureJudge(StatefulProcessor):
    """Passes captures of a group of sessions that are open and changed; marks those that came too late to be judged."""

    def __init__(self, pause_on_suspend: bool, pause_when_locked: bool, idle_days: float):
        self.gates, self.ttl = (pause_on_suspend, pause_when_locked), max(1, round(idle_days * 86_400_000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getMapState("flags", "session string", FLAGS, self.ttl)
        self.windows = handle.getMapState("windows", "session string, window_id string", "frame_hash string, second long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        rows.columns = JUDGED  # Spark's rows lose names that begin with an underscore
        rows = rows.sort_values(["in_key", "ts", "_side", "seq"], kind="stable", ignore_index=True)
        spans = spans_of(rows["in_key"].to_numpy())
        before = [tuple(self.flags.getValue((session,))) if self.flags.containsKey((session,)) else None for session, _, _ in spans]
        open_, late, after = gate_spans(rows, spans, before, *self.gates)
        states = rows["_side"].to_numpy() == 0
        for (session, low, high), flags in zip(spans, after):
            if states[low:high].any():
                self.flags.updateValue((session,), flags)
        kept = np.zeros(len(rows), bool)
        seconds = rows["ts"].to_numpy().astype("datetime64[s]").astype("int64")
        hashes = rows["_hash"].astype(object).where(rows["_hash"].notna(), None).to_numpy()
        for window, at in rows[open_].groupby(["in_key", "_window"], sort=False).indices.items():
            at = np.flatnonzero(open_)[at]
            last = tuple(self.windows.getValue(window)) if self.windows.containsKey(window) else None
            changed, behind, now = changed_rows(seconds[at], hashes[at].tolist(), last)
            kept[at[changed]] = True
            late[at[behind]] = True
            if now is not None and now != last:
                self.windows.updateValue(window, now)
        out = kept | late
        if out.any():
            yield pd.DataFrame({"row": rows.loc[out, "_row"].to_numpy(), "late": late[out]})

    def close(self) -> None:
        pass


def judged_captures(captures: DataFrame, states: DataFrame, idle_days: float = IDLE_DAYS, pause_on_suspend: bool = True, pause_when_locked: bool = True) -> DataFrame:
    """Kept captures with `late`, from a stream of captures and one of state signals, by one stateful operator.

    The captures travel as JSON beside the columns that are judged, so that no type changes on the way through Python.
    """
    left = captures.select(
        "session", "ts", "seq", F.lit(1).alias("_side"), F.lit("").alias("_kind"), F.lit(False).alias("_active"),
        F.col("window_id").alias("_window"), F.col("frame_hash").alias("_hash"), F.to_json(F.struct(*captures.columns)).alias("_row"),
    )
    right = states.select(
        "session", "ts", "seq", F.lit(0).alias("_side"), F.col("kind").alias("_kind"), F.col("active").alias("_active"),
        *(F.lit(None).cast("string").alias(c) for c in ("_window", "_hash", "_row")),
    )
    judge = CaptureJudge(pause_on_suspend, pause_when_locked, idle_days)
    grouped = in_groups(left.unionByName(right), ["session"]).select(*JUDGED).groupBy("in_group")
    out = grouped.transformWithStateInPandas(judge, "row string, late boolean", "append", "ProcessingTime")
    return out.select(F.from_json("row", captures.schema).alias("row"), "late").select("row.*", "late")


@contextmanager
def several_variables(spark: SparkSession):
    """Start streams inside this block: they take the state store that can hold several variables per key.

    Expiry by the clock would ask for empty micro-batches without end, so that a query that drains its sources would never stop. They are
    switched off: expired state is not read in any case, and goes with the next micro-batch that has rows.
    """
    wanted = {PROVIDER: ROCKSDB, EMPTY_BATCHES: "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_batch(store: ArchiveStore, frames: DataFrame, extract: Extract, batch: int) -> None:
    """Texts of one micro-batch as one batch of the store; captures that gave none, or came too late, go to `dead_letters`.

    Tables that hold the batch already are left alone. The micro-batch is read to its end even then, for that is what stores the state.
    """
    key = capture_key(F.col("window_id"), F.col("ts"))
    frames = frames.persist()
    made = extract(frames.filter("NOT late").drop("late")).persist()
    try:
        missing = [t for t in ("texts", "dead_letters") if not store.has_batch(t, batch)]
        if "texts" in missing:
            rows = texts_to_write(made.filter("error IS NULL")).withColumn("day", F.to_date("ts"))
            store.append("texts", rows.repartition("day"), batch)
        if "dead_letters" in missing:
            failed = made.filter("error IS NOT NULL").select(key.alias("path"), "error")
            late = frames.filter("late").select(key.alias("path"), F.lit("late").alias("error"))
            store.append("dead_letters", failed.unionByName(late), batch)
        if not missing:
            frames.write.format("noop").mode("overwrite").save()
    finally:
        made.unpersist()
        frames.unpersist()


def capture_stream(
    captures: DataFrame, states: DataFrame, store: ArchiveStore, extract: Extract, checkpoint: str, excluded: str | list[str] = "",
    every: str | None = None, idle_days: float = IDLE_DAYS, **gates: bool,
) -> DataStreamWriter:
    """The ingest pipeline as one query; `start` begins it. Without `every` it drains what is there and stops.

    `extract` turns frames into rows with `text` and `error`, as `operators.extract` does. Missing windows and excluded titles are dropped before the state.
    """
    frames = judged_captures(exclude_titles(with_window(captures), excluded), states, idle_days, **gates)

    def write(df: DataFrame, step: int) -> None:
        write_batch(store, df, extract, store.reserve(stream_id(store.spark, checkpoint), step))

    writer = frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Begin a capture stream with the state store that it needs."""
    with several_variables(spark):
        return writer.start()


def stored_texts(store: ArchiveStore, files_per_trigger: int = 1000) -> DataFrame:
    """The store's texts as a stream, which `index_stream` reads; new batches arrive as files."""
    rows = store.spark.readStream.schema(stored_schema("texts")).option("maxFilesPerTrigger", files_per_trigger)
    return rows.parquet(store.location("texts")).select(*DOCS.fieldNames())
