import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import captures as C
from daybook.operators import states as S
from daybook.operators.throttle import throttle
from tests.helpers import at, captures, plan, states, values


def test_with_window(spark):
    rows = [("a", 1, 1, "h"), (None, 2, 2, "h"), ("", 3, 3, "h"), ("b", 4, 4, "h", ""), ("b", 5, 5, "h", None)]
    assert values(C.with_window(captures(spark, rows)), "seq") == [1]


TITLES = [("a", 1, 1, "h", "My BANK"), ("a", 2, 2, "h", "Editor"), ("a", 3, 3, "h", "Mail - Inbox")]


@pytest.mark.parametrize(
    "terms, kept", [([], [1, 2, 3]), ('""', [1, 2, 3]), (["bank"], [2, 3]), ('"BANK, mail"', [2]), (["a", "i"], [])]
)
def test_exclude_titles(spark, terms, kept):
    assert values(C.exclude_titles(captures(spark, TITLES), terms), "seq") == kept


def test_exclude_titles_by_table_and_long_list(spark):
    table = spark.createDataFrame([("Bank",), (" ",)], "term string")
    assert values(C.exclude_titles(captures(spark, TITLES), table), "seq") == [2, 3]
    many = [f"nothing{i}" for i in range(100)] + ["inbox"]
    assert values(C.exclude_titles(captures(spark, TITLES), many), "seq") == [1, 2]


def test_same_second_keeps_the_first(spark):
    rows = [("a", 1.2, 1, "x"), ("a", 1.8, 2, "y"), ("a", 2.0, 3, "x"), ("b", 1.5, 4, "x")]
    assert values(C.first_per_key(captures(spark, rows)), "seq") == [1, 3, 4]
    # The first of the second is what the next frame is compared with.
    assert values(C.drop_unchanged(captures(spark, rows)), "seq") == [1, 4]


def test_drop_unchanged_a_b_a_and_windows(spark):
    rows = [("a", 1, 1, "x"), ("b", 2, 2, "x"), ("a", 3, 3, "x"), ("a", 4, 4, "y"), ("a", 5, 5, "x"), ("b", 6, 6, "x")]
    assert values(C.drop_unchanged(captures(spark, rows)), "seq") == [1, 2, 4, 5]


def brute_unchanged(rows):
    last, seconds, kept = {}, set(), []
    for w, t, n, h, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        if (w, int(t)) in seconds:
            continue
        seconds.add((w, int(t)))
        if last.get(w, object()) != h:
            kept.append(n)
        last[w] = h
    return sorted(kept)


@pytest.mark.parametrize("slice_seconds", [1, 7, 3600])
def test_drop_unchanged_hot_window_over_slices(spark, slice_seconds):
    rnd = random.Random(slice_seconds)
    rows = [
        ("hot" if rnd.random() < 0.6 else f"w{rnd.randrange(5)}", rnd.uniform(0, 300), n, rnd.choice("xyz"))
        for n in range(400)
    ]
    once = C.drop_unchanged(captures(spark, rows), slice_seconds)
    assert values(once, "seq") == brute_unchanged(rows)
    assert values(C.drop_unchanged(once, slice_seconds), "seq") == values(once, "seq")


def test_null_hash_is_a_value(spark):
    rows = [("a", 1, 1, None), ("a", 2, 2, None), ("a", 3, 3, "x"), ("a", 4, 4, None)]
    assert values(C.drop_unchanged(captures(spark, rows)), "seq") == [1, 3, 4]


def test_frames_without_text(spark):
    frames = captures(spark, [("a", 1.5, 1, "x"), ("a", 2, 2, "y")])
    texts = spark.createDataFrame([("a_1704067201.txt",)], "path string")
    assert values(C.frames_without_text(frames, texts), "seq") == [2]


def test_first_per_key_cuts_before_the_shuffle(spark):
    text = plan(C.first_per_key(captures(spark, TITLES)))
    assert text.index("WindowGroupLimit") < text.index("Exchange") or "Partial" in text


# -- states ------------------------------------------------------------------------------------


def test_asof_edges(spark):
    caps = captures(spark, [("s", 0, 1, "x"), ("s", 10, 2, "x"), ("s", 20, 3, "x"), ("t", 20, 4, "x"), (None, 20, 5, "x")])
    st = states(spark, [("s", 10, 1, "lock", True), ("s", 20, 1, "lock", True), ("s", 20, 2, "lock", False), (None, 1, 1, "lock", True)])
    got = values(S.asof_state(caps, st), "seq", "lock_active", "suspend_active")
    assert got == [(1, None, None), (2, True, None), (3, False, None), (4, None, None), (5, None, None)]


def test_gate_order_and_switches(spark):
    caps = captures(spark, [("s", t, t, "x") for t in (5, 15, 25, 35)])
    st = states(
        spark,
        [("s", 10, 1, "lock", True), ("s", 20, 2, "suspend", True), ("s", 30, 3, "suspend", False), ("s", 34, 4, "lock", False)],
    )
    assert values(S.paused_reason(caps, st), "seq", F.coalesce("drop_reason", F.lit("-"))) == [
        (5, "-"), (15, "locked"), (25, "suspended"), (35, "-"),
    ]
    assert values(S.gate_paused(caps, st), "seq") == [5, 35]
    assert values(S.gate_paused(caps, st, pause_when_locked=False), "seq") == [5, 15, 35]
    assert values(S.gate_paused(caps, st, pause_on_suspend=False), "seq") == [5, 35]


@pytest.mark.parametrize("slice_seconds", [1, 13, 100000])
def test_states_over_slices(spark, slice_seconds):
    rnd = random.Random(slice_seconds)
    signals = [
        (rnd.choice("aab"), rnd.randrange(200), n, rnd.choice(["lock", "suspend"]), rnd.random() < 0.5) for n in range(120)
    ]
    caps = [(rnd.choice("abc"), rnd.randrange(200), n, "x") for n in range(150)]
    known = {}
    for c in caps:
        for kind in ("suspend", "lock"):
            past = [s for s in signals if s[0] == c[0] and s[3] == kind and s[1] <= c[1]]
            known[c[2], kind] = max(past, key=lambda s: (s[1], s[2]))[4] if past else None
    got = S.asof_state(captures(spark, caps), states(spark, signals), slice_seconds=slice_seconds).collect()
    assert {(r.seq, k): r[f"{k}_active"] for r in got for k in ("suspend", "lock")} == known

    changes, spans, on = [], [], {}
    for s, t, n, k, a in sorted(signals, key=lambda x: (x[1], x[2])):
        if a != on.get((s, k), (False, 0))[0]:
            changes.append(n)
            if not a:
                spans.append((s, k, at(on[s, k][1]), at(t)))
            on[s, k] = (a, t)
    assert values(S.state_transitions(states(spark, signals), slice_seconds), "seq") == sorted(changes)
    got = S.pause_intervals(states(spark, signals), slice_seconds)
    assert values(got.filter("end_ts IS NOT NULL"), "session", "kind", "start_ts", "end_ts") == sorted(spans)
    assert got.filter("end_ts IS NULL").count() == sum(a for a, _ in on.values())


# -- throttle ----------------------------------------------------------------------------------


def brute_throttle(rows, interval):
    last, kept = {}, []
    for k, t, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] > interval:
            last[k] = t
            kept.append(n)
    return sorted(kept)


@pytest.mark.parametrize("seed, span, intervals", [(1, 300, 2), (2, 3000, 3), (3, 30000, 100), (4, 600, 1)])
def test_throttle_equals_the_sequential_rule(spark, seed, span, intervals):
    rnd = random.Random(seed)
    rows = [(rnd.choice("aaab"), rnd.randrange(span), n) for n in range(600)]
    df = spark.createDataFrame([(k, at(t), n) for k, t, n in rows], "k string, ts timestamp, seq long")
    got = throttle(df, ["k"], 60, slice_seconds=500, slice_intervals=intervals)
    assert values(got, "seq") == brute_throttle(rows, 60)


def test_throttle_is_strict(spark):
    df = spark.createDataFrame([("a", at(t), t) for t in (0, 60, 61, 121, 122)], "k string, ts timestamp, seq long")
    assert values(throttle(df, ["k"], 60), "seq") == [0, 61, 122]
