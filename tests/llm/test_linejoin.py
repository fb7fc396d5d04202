import random
import re

import pytest
from pyspark.sql import functions as F

from daybook.llm import linejoin as J
from tests.llm.cases import docs, rows, same_as_sql


def edit(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(last[j] + (x != y), last[j + 1] + 1, new[j] + 1))
        last = new
    return last[-1]


def changed(rng, text, times, letters="abcé"):
    text = list(text)
    for _ in range(times):
        at = rng.randrange(len(text) + 1)
        kind = rng.random()
        if kind < 0.4:
            text.insert(at, rng.choice(letters))
        elif at < len(text):
            text[at : at + 1] = [rng.choice(letters)] if kind < 0.7 else []
    return "".join(text)


def test_band_distance_is_exact_up_to_the_allowance(spark):
    rng = random.Random(3)
    for edits in (1, 2, 3):
        made = []
        while len(made) < 400:
            a = "".join(rng.choice("abcé") for _ in range(rng.randint(4, 24)))
            a, b = sorted((a, changed(rng, a, rng.randint(0, 5))), key=len)
            if edits < len(a) and len(b) <= len(a) + edits:
                made.append((a, b))
        df = spark.createDataFrame(made, "a string, b string")
        for r in df.select("a", "b", J.band_distance(F.split("a", ""), F.split("b", ""), edits).alias("d")).collect():
            true = edit(r.a, r.b)
            assert r.d == true if true <= edits else r.d > edits


@pytest.mark.parametrize("shared", [16, 2])
def test_all_links_are_found(spark, monkeypatch, shared):
    monkeypatch.setattr(J, "SHARED", shared)  # segments of few lines count as shared by many
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    lines += [changed(rng, rng.choice(lines), rng.randint(1, 3)) for _ in range(160)]
    lines += ["same line here"] * 30 + [f"common start of many lines {i:03d}" for i in range(60)]
    rng.shuffle(lines)
    given = [(i, "\n".join(lines[i * 8 : i * 8 + 8]), None, None, 0) for i in range(len(lines) // 8 + 1)]
    for edits in (1, 2, 3) if shared > 2 else (2,):
        got = {(r.doc_id, r.line_no): r for r in J.join_lines(docs(spark, given), edits=edits).collect()}
        flat = [(i, k, x.strip(J.BLANKS)) for i, t, *_ in given for k, x in enumerate(t.split("\n")) if x.strip(J.BLANKS)]
        assert set(got) == {(i, k) for i, k, _ in flat}
        first = {}
        for i, k, x in flat:
            first.setdefault(x, (i, k))
        near = {x: [y for y in first if x != y and edit(x, y) <= min(edits, max(len(x), len(y)) // 5)] for x in first}
        for i, k, x in flat:
            r = got[i, k]
            assert (r.n_links, r.n_copies) == (len(near[x]), sum(z == x for *_, z in flat))
            assert r.kept == ((i, k) == first[x] and all(first[y] > first[x] for y in near[x]))
            assert (r.class_id == got[first[x]].class_id) and edits < 4


def test_awkward_rows_equal_sql(spark):
    given = rows()[:40] + [(50, "plain text line one\nplain text line two\n\n  plain text line one \t", None, None, 0)]
    same_as_sql(J.join_lines(docs(spark, given)), J.ORACLE, given)
    assert J.join_lines(docs(spark, [])).count() == 0
    assert J.join_lines(docs(spark, [(1, None, None, None, 0), (None, "", None, None, 0)])).count() == 0


def test_plan_is_native_and_texts_stay_where_they_are(spark):
    from tests.helpers import plan

    table = docs(spark, rows())
    lines = J.lines_of(table, "doc_id", "text")
    classes = spark.createDataFrame([], "n_copies long, bucket long")
    for text in (plan(J.join_lines(table)), plan(J.candidates(lines, classes, 2))):
        assert not re.search("EvalPython|InArrow|InPandas|CartesianProduct|NestedLoop", text)


def test_lines_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(J, "COPIES", 3)
    given = [(i, "a common line of text\na common line of test\nrare line number " + "xyzvw"[i % 5], None, None, 0) for i in range(20)]
    same_as_sql(J.join_lines(docs(spark, given)), J.ORACLE, given)


def test_own_segments_are_shuffled_once_and_each_way_is_probed_once(spark):
    assert [len(J.probed(e)) for e in (1, 2, 3)] == [2, 8, 20]
    assert not any(less == 0 and shift <= 0 for e in (1, 2, 3) for less, _, shift in J.probed(e))
    # Equally long lines that only meet through a shifted middle segment, in either order.
    given = [(i, t, None, None, 0) for i, t in enumerate(["abcdefghijklmnopqr", "Xabcdefghijklmnopq", "123456789012345678", "234567890123456789"])]
    links = {r.doc_id: r.n_links for r in J.join_lines(docs(spark, given)).collect()}
    assert links == {0: 1, 1: 1, 2: 1, 3: 1}


def test_lines_are_brought_down_to_one_without_sorting_them(spark, monkeypatch):
    from tests.helpers import plan

    written, stored = {}, J.stored
    monkeypatch.setattr(J, "stored", lambda df, label: written.setdefault(label, plan(df)) and stored(df, label))
    given = [(i, "a common line of text\na common line of test", None, None, 0) for i in range(5)]
    assert {(r.n_copies, r.n_links) for r in J.join_lines(docs(spark, given)).collect()} == {(5, 1)}
    assert {"cut", "lines"} <= set(written) and not any("SortAggregate" in written[x] for x in ("cut", "lines"))


def test_trimming_and_cutting_leave_what_they_left(spark):
    blanks = [*J.BLANKS, "", "\u00a0"]
    lines = [a + x + b for a in blanks for b in blanks for x in ("", "x", "two words", "x \t y", "né \u20ac \U0001f600 n")] + [" \t ", "\r\r", "\u0000"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("n", F.length("line"))
    got = df.select("line", J.trimmed(F.col("line")).alias("t"), *(J.cut_out("line", "n", F.lit(at), F.lit(size)).alias(f"c{at}{size}") for at in range(3) for size in range(4)))
    for r in got.collect():
        assert r.t == r.line.strip(J.BLANKS)
        assert all(bytes(r[f"c{at}{size}"]) == r.line[at : at + size].encode() for at in range(3) for size in range(4))
