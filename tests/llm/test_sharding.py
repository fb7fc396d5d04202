from collections import Counter, defaultdict

from pyspark.sql import functions as F

from daybook.llm import sharding as S
from tests.helpers import plan
from tests.llm.cases import docs, rows, same_as_sql


def test_equals_sql(spark):
    given = [r for r in rows() if r[0] is not None][:40] + [(i, f"t{i}é", None, None, 0) for i in range(1000, 1100)]
    same_as_sql(S.place(docs(spark, given)), S.ORACLE, given)


def test_growth_takes_rows_only_into_the_new_shard(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    for weights, added in (([1.0] * 8, 1.0), ([1.0, 2.0, 5.0], 2.0)):
        now = keys.withColumn("shard", S.shard_of(F.col("k"), weights))
        now = now.withColumn("grown", S.grown_shard(F.col("k"), "shard", weights, added)).withColumn("again", S.shard_of(F.col("k"), weights + [added]))
        got = now.collect()
        assert all(r.grown == r.again and r.grown in (r.shard, len(weights)) for r in got)
        moved = sum(r.grown != r.shard for r in got) / len(got)
        assert abs(moved - added / (sum(weights) + added)) < 0.03
        share = Counter(r.shard for r in got)
        assert all(abs(share[i] / len(got) - w / sum(weights)) < 0.04 for i, w in enumerate(weights))


def test_slots_are_gapless_and_awkward_rows_have_a_place(spark):
    got = S.place(docs(spark)).collect()
    assert len(got) == len(rows())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.size == len((next(t for i, t, *_ in rows() if i == r.doc_id) or "").encode()) + 1 or r.doc_id is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert S.place(docs(spark, [])).count() == 0


def test_zero_weight_closes_a_shard_and_plan_is_native(spark):
    keys = spark.range(200).select(F.col("id").cast("string").alias("k"))
    assert keys.select(S.shard_of(F.col("k"), [0.0, 1.0, 1.0]).alias("s")).where("s = 0").count() == 0
    assert "EvalPython" not in plan(S.place(docs(spark))) and S.sharded(docs(spark)).columns[-1] == "shard"
