"""Helpers: components, running sums, column names, slices."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from daybook.llm import graph, order
from daybook.llm.batches import fresh, slices


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (80, 30), (30, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 560)]
        got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for node, root in got.items():
            seen, todo = {node}, [node]
            while todo:
                for x in near[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            assert root == min(seen)
        assert set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_components_without_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_running_sum_equals_one_window(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.randrange(50), rng.randrange(9)) for _ in range(400)]
    rows = spark.createDataFrame([(k, p, p // 7, v, i) for i, (k, p, v) in enumerate(data)], "k string, p int, b int, v long, i int").cache()
    got = {r.i: r.s for r in order.running(rows, ["k"], "b", [F.col("p"), F.col("i")], F.col("v"), "s").collect()}
    for i, (k, p, _) in enumerate(data):
        assert got[i] == sum(v for j, (k2, p2, v) in enumerate(data) if k2 == k and (p2, j) < (p, i))


def test_names_and_slices():
    assert fresh(["A", "a_"], "a") == "a__"
    long = "x" * 3_000_000
    assert [len(s) for s in slices(pa.array([long, long, None, "y"]))] == [2, 2]
