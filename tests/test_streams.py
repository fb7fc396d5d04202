import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import captures as C
from daybook.operators import states as S
from daybook.operators.embed import default_encoder
from daybook.operators.postings import build_postings, live_postings
from daybook.plans.cycle import load_vector_index
from daybook.sources.feeds import stream_table
from daybook.sources.store import ArchiveStore
from daybook.streaming import captures as ST
from daybook.streaming.index import index_stream
from tests.helpers import captures, docs, states, values
from tests.test_captures import brute_throttle


def arriving(spark, df, path, cuts):
    """One file per span of seconds, in time order."""
    begin = 1704067200
    for low, high in zip([0, *cuts], [*cuts, 10**6]):
        part = df.filter((F.unix_seconds("ts") >= begin + low) & (F.unix_seconds("ts") < begin + high))
        part.repartition(1).write.mode("append").parquet(path)
    return stream_table(spark, path, df.schema, files_per_trigger=1)


def drain(spark, stream, folder):
    ST.ingest(stream, f"{folder}/sink", f"{folder}/ck").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/sink")


def sample(seed, n=150, span=200):
    rnd = random.Random(seed)
    caps = [(rnd.choice("aab"), rnd.uniform(0, span), i, rnd.choice("xy")) for i in range(n)]
    signals = [(rnd.choice("ab"), rnd.uniform(0, span), i, rnd.choice(["lock", "suspend"]), rnd.random() < 0.5) for i in range(40)]
    return caps, signals


@pytest.mark.parametrize("cuts", [[], [50, 51, 160]])
def test_drop_unchanged_stream_equals_batch(spark, folder, cuts):
    batch = captures(spark, sample(len(cuts))[0])
    got = drain(spark, ST.drop_unchanged_stream(arriving(spark, batch, f"{folder}/in", cuts)), folder)
    assert values(got.filter("NOT late"), "seq") == values(C.drop_unchanged(batch), "seq")
    assert got.filter("late").count() == 0


def test_late_rows_go_to_the_side(spark, folder):
    captures(spark, [("a", 10, 1, "x")]).write.parquet(f"{folder}/in")
    captures(spark, [("a", 5, 2, "y"), ("a", 11, 3, "x"), ("a", 12, 4, "z")]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = stream_table(spark, f"{folder}/in", captures(spark, [("a", 1, 1, "x")]).schema, files_per_trigger=1)
    got = drain(spark, ST.drop_unchanged_stream(source), folder)
    assert values(got, "seq", "late") == [(1, False), (2, True), (4, False)]


def test_gate_stream_equals_batch(spark, folder):
    caps, signals = sample(5)
    cap, sig = captures(spark, caps), states(spark, signals)
    cuts = [40, 90]
    stream = ST.gate_stream(arriving(spark, cap, f"{folder}/c", cuts), arriving(spark, sig, f"{folder}/s", cuts))
    got = drain(spark, stream, folder)
    assert values(got, "seq") == values(S.gate_paused(cap, sig), "seq") and got.filter("late").count() == 0


def test_throttle_stream_equals_batch(spark, folder):
    caps, _ = sample(7)
    df = captures(spark, caps).select(F.col("window_id").alias("k"), "ts", "seq")
    got = drain(spark, ST.throttle_stream(arriving(spark, df, f"{folder}/in", [30, 100, 101]), ["k"], 20), folder)
    assert values(got, "seq") == brute_throttle([(w, t, n) for w, t, n, _ in caps], 20)


def swapped(spark, df, path, cuts):
    """Files of time spans, the second span arriving last."""
    begin = 1704067200
    spans = list(zip([0, *cuts], [*cuts, 10**6]))
    for low, high in (spans[0], *spans[2:], spans[1]):
        part = df.filter((F.unix_seconds("ts") >= begin + low) & (F.unix_seconds("ts") < begin + high))
        part.repartition(1).write.mode("append").parquet(path)
    return stream_table(spark, path, df.schema, files_per_trigger=1)


def test_late_events_of_a_throttle_are_marked(spark, folder):
    caps, _ = sample(9)
    df = captures(spark, caps).select(F.col("window_id").alias("k"), "ts", "seq")
    got = drain(spark, ST.throttle_stream(swapped(spark, df, f"{folder}/in", [60, 120]), ["k"], 20), folder)
    in_time = [r for r in caps if not 60 <= int(r[1]) < 120]
    assert values(got.filter("NOT late"), "seq") == brute_throttle([(w, t, n) for w, t, n, _ in in_time], 20)
    assert values(got.filter("late"), "seq") == sorted(n for _, t, n, _ in caps if 60 <= int(t) < 120)


def test_late_captures_and_states_of_a_gate(spark, folder):
    cap = captures(spark, [("a", 10, 1, "x"), ("a", 70, 2, "x"), ("a", 130, 3, "x")])
    sig = states(spark, [("a", 5, 1, "lock", True), ("a", 65, 2, "lock", True), ("a", 125, 3, "lock", False)])
    sources = swapped(spark, cap, f"{folder}/c", [60, 120]), swapped(spark, sig, f"{folder}/s", [60, 120])
    got = drain(spark, ST.gate_stream(*sources), folder)
    # The capture of second 70 comes after the state of second 125 was known; that state is not overwritten.
    assert values(got, "seq", "late") == [(2, True), (3, False)]


def test_cycles_and_streams_share_one_store(spark, folder):
    from daybook.plans.cycle import run_cycle

    rows = [(f"d{i:02d}", f"text {i}") for i in range(12)]
    store, enc = ArchiveStore(spark, f"{folder}/store"), default_encoder(8)
    schema = docs(spark, rows).schema

    def stream(part, name):
        docs(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        return index_stream(stream_table(spark, f"{folder}/{name}", schema, files_per_trigger=1), store, enc, f"{folder}/ck-{name}").start()

    run_cycle(store, docs(spark, rows[:3]), enc)
    stream(rows[3:6], "one").awaitTermination()
    run_cycle(store, docs(spark, rows[:8]), enc)
    stream(rows[8:10], "two").awaitTermination()
    stream(rows[10:], "one").awaitTermination()
    assert values(load_vector_index(store), "path") == [p for p, _ in rows]
    assert values(load_vector_index(store), "id") == list(range(12))
    assert values(live_postings(store), "term", "path") == values(build_postings(docs(spark, rows)), "term", "path")


def test_a_micro_batch_repeated_after_another_writer_changes_nothing(spark, folder):
    from daybook.plans.cycle import run_cycle
    from daybook.streaming.index import index_batch

    store, enc = ArchiveStore(spark, f"{folder}/store"), default_encoder(8)
    first, later = docs(spark, [("a", "x"), ("b", "y")]), docs(spark, [("a", "x"), ("b", "y"), ("c", "z")])
    index_batch(store, first, enc, store.reserve("s", 0))
    run_cycle(store, later, enc)
    before = values(load_vector_index(store), "id", "path")
    index_batch(store, first, enc, store.reserve("s", 0))
    assert values(load_vector_index(store), "id", "path") == before == [(0, "a"), (1, "b"), (2, "c")]


def test_frame_streams_equal_the_batch_chain(spark, folder):
    caps, signals = sample(11)
    cap, sig = captures(spark, caps), states(spark, signals)
    sources = arriving(spark, cap, f"{folder}/c", [80]), arriving(spark, sig, f"{folder}/s", [80])
    for stream in ST.frame_streams(*sources, folder, ["nothing"]):
        stream.start().awaitTermination()
    want = C.drop_unchanged(C.exclude_titles(C.with_window(S.gate_paused(cap, sig)), ["nothing"]))
    assert values(spark.read.parquet(f"{folder}/kept").filter("NOT late"), "seq") == values(want, "seq")


def test_index_stream_survives_a_crash_after_the_write(spark, folder, monkeypatch):
    from daybook.streaming import index as IX

    rows = [(f"d{i}", f"text {i}") for i in range(6)]
    schema = docs(spark, rows).schema
    for low in (0, 3):
        docs(spark, rows[low : low + 3]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    store, enc = ArchiveStore(spark, f"{folder}/store"), default_encoder(8)
    real, calls = IX.append_vectors, []

    def crash(*args):
        real(*args)
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("power cut")

    monkeypatch.setattr(IX, "append_vectors", crash)
    start = lambda: index_stream(
        stream_table(spark, f"{folder}/in", schema, files_per_trigger=1), store, enc, f"{folder}/ck"
    ).start()
    with pytest.raises(Exception, match="power cut"):
        start().awaitTermination()
    start().awaitTermination()
    assert values(load_vector_index(store), "id", "path") == [(i, f"d{i}") for i in range(6)]
    want = values(build_postings(docs(spark, rows)), "term", "path", "tf")
    assert values(live_postings(store), "term", "path", "tf") == want


@pytest.mark.parametrize("groups", [1, 16])
def test_many_sessions_share_the_state_of_a_group(spark, folder, monkeypatch, groups):
    monkeypatch.setattr(ST, "GROUPS", groups)
    rnd = random.Random(groups)
    names = [None, *(f"s{i}" for i in range(60))]
    caps = [(rnd.choice(names), rnd.uniform(0, 200), i, rnd.choice("xy")) for i in range(400)]
    signals = [(rnd.choice(names[1:]), rnd.uniform(0, 200), i, rnd.choice(["lock", "suspend"]), rnd.random() < 0.5) for i in range(200)]
    cap, sig, cuts = captures(spark, caps), states(spark, signals), [70, 140]
    stream = ST.gate_stream(arriving(spark, cap, f"{folder}/c", cuts), arriving(spark, sig, f"{folder}/s", cuts))
    query = ST.ingest(stream, f"{folder}/sink", f"{folder}/ck").start()
    query.awaitTermination()
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= groups
    got = spark.read.schema(stream.schema).parquet(f"{folder}/sink")
    assert values(got, "seq") == values(S.gate_paused(cap, sig), "seq") and got.filter("late").count() == 0


def test_an_idle_key_loses_its_state_and_others_of_its_group_keep_theirs(spark, folder, monkeypatch):
    monkeypatch.setattr(ST, "GROUPS", 1)
    day = 86_400
    rows = [("a", 0, 1, "x"), ("b", 80 * day, 2, "x"), ("c", 100 * day, 3, "x"), ("c", 101 * day, 4, "x"), ("a", 102 * day, 5, "x"), ("b", 103 * day, 6, "x")]
    for row in rows:
        captures(spark, [row]).write.mode("append").parquet(f"{folder}/in")
    source = stream_table(spark, f"{folder}/in", captures(spark, rows).schema, files_per_trigger=1)
    # The state of "a" ended when the stream's time passed its day 90; the frame of "b" is still known.
    assert values(drain(spark, ST.drop_unchanged_stream(source), folder), "seq") == [1, 2, 3, 5]
