from collections import Counter, defaultdict

from pyspark.sql import functions as F

from daybook.llm import mixing as M
from tests.llm.cases import docs, rows, same_as_sql, values

SQL = M.ORACLE.replace("SELECT doc_id, size, source_size", "SELECT doc_id, source, size, source_size")


def settle(sizes, weights=(3, 1, 2)):
    """Targets by resharing the excess until none is above, as the rule reads."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target = 1.5 * sum(sizes.values()), {}
    free = set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return target


def test_equals_sql_and_rules(spark):
    given = [r for r in rows() if r[0] is not None][:40] + [(300 + i, "w " * i, f"l{i}", f"s{i % 9}", 0) for i in range(60)]
    got = M.mix(docs(spark, given), block=16).collect()
    same_as_sql(M.mix(docs(spark, given), block=16), SQL, given)
    sizes, taken = defaultdict(int), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    want = settle(sizes)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert values(M.mix(docs(spark, given), block=16), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)


def test_block_size_does_not_change_takes(spark):
    given = [r for r in rows() if r[0] is not None]
    assert values(M.mix(docs(spark, given), block=7), "doc_id", "taken") == values(M.mix(docs(spark, given), block=4096), "doc_id", "taken")


def test_schedule_is_even(spark):
    goal = spark.createDataFrame([("a", 30000.0), ("b", 10000.0), (None, 20000.0), ("z", 0.0)], "source string, target double")
    slots = M.schedule(spark, goal, block=10, chunk=64).collect()
    turns = defaultdict(list)
    for r in sorted(slots, key=lambda r: r.slot):
        turns[r.source].append(r)
    assert {s: sum(r.words for r in x) for s, x in turns.items()} == {"a": 30000, "b": 10000, None: 20000}
    assert all([r.turn for r in x] == list(range(len(x))) for x in turns.values())
    for cut in (200, 1000, 3000):
        share = Counter(r.source for r in slots if r.slot < cut)
        assert all(abs(share[s] - cut * w / 6) <= 6 for s, w in (("a", 3), ("b", 1), (None, 2)))


def test_small_sources_beside_a_hot_one_have_all_turns(spark):
    small = {**{f"s{i:02}": 1.0 for i in range(40)}, "t2": 2.0, "t5": 5.0, "t10": 10.0, None: 3.0}
    goal = spark.createDataFrame([("hot", 1e6), *small.items()], "source string, target double")
    got = M.schedule(spark, goal, block=1).groupBy("source").agg(F.count("*").alias("n"), F.max("turn").alias("last"), F.sum("words").alias("words"))
    assert {r.source: (r.n, r.last, r.words) for r in got.collect()} == {s: (n, n - 1, n) for s, n in [("hot", 10**6), *small.items()]}


def test_awkward_rows(spark):
    assert M.mix(docs(spark, [])).count() == 0
    none = M.mix(docs(spark, [(1, None, None, None, 0), (2, "", None, "a", 0)])).collect()
    assert {(r.size, r.taken, r.target) for r in none} == {(0, 0, 0.0)}
    assert M.mix(docs(spark)).count() == len(rows())


def test_mixed_documents_repeat_rows(spark):
    given = rows()
    table = docs(spark, given)
    out = M.mixed_documents(table, block=16)
    assert out.columns == table.columns
    got = Counter(r.doc_id for r in out.collect())
    taken = {r.doc_id: r for r in M.mix(docs(spark, [r for r in given if given.count(r) == 1 and r[0] is not None]), block=16).collect()}
    assert all(n <= 2 for i, n in got.items() if i in taken and i not in (20,))
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert abs(words - 1.5 * sum(len((r[1] or "").split()) for r in given)) <= 0.05 * words + 3100
    assert M.mixed_documents(docs(spark, [])).count() == 0
