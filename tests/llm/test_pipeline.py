"""The pipeline beside a brute-force version over small tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from daybook.llm import language
from daybook.runtime import scratch
from tests.llm.cases import docs
from tests.llm.test_language import WORDS
from tests.llm.test_simhash import brute, plain_fingerprint


def corpus():
    own = {k: v.split() for k, v in WORDS.items()}
    out = []
    for i in range(120):
        lang = "xy"[i % 2]
        out.append((i, " ".join(own[lang][(i * k + k // 3) % 4] + "ab"[(i >> (k % 7)) % 2] * (k % 3) for k in range(1, 40)), lang, "pqr"[i % 3], 0))
    out[40] = (40, out[2][1], "x", "p", 0)
    out[41] = (41, None, "x", "p", 0)
    out[42] = (42, "12 34", None, "p", 0)
    return out


@pytest.fixture
def tables(spark):
    path = scratch(spark, "pipeline")
    given = corpus()
    items = [(1, " ".join(given[7][1].split()[:20])), (2, "unseen words of a test item")]
    docs(spark, given).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, given, items


def test_stages_equal_brute_force(spark, tables):
    path, given, items = tables
    table = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(C.STAGES)
    model = language.fit(table)
    spoken = [r for r in given if model.predict([r[1]])[0][0] != "und" and model.predict([r[1]])[0][1] >= C.LEAST_SCORE]
    one = stage["language ID"](spark, table, path)
    assert sorted(r.doc_id for r in one.collect()) == [r[0] for r in spoken] and one.columns == table.columns
    two = stage["SimHash near-dedup"](spark, one, path)
    parts = brute([(i, plain_fingerprint(t)) for i, t, *_ in spoken])
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for *_, c in parts})
    three = stage["benchmark decontamination"](spark, two, path)
    windows = {tuple(t.split()[i : i + 13]) for _, t in items for i in range(max(1, len(t.split()) - 12))}

    def hit(text):
        w = text.split()
        at = {k for i in range(len(w)) for x in windows if tuple(w[i : i + len(x)]) == x for k in range(i, i + len(x))}
        return bool(at) and 20 * len(at) >= len(w)

    texts = {r[0]: r[1] for r in given}
    assert sorted(r.doc_id for r in three.collect()) == sorted(r.doc_id for r in two.collect() if not hit(texts[r.doc_id]))
    four = stage["mixing sources"](spark, three, path)
    assert four.columns == table.columns and set(r.doc_id for r in four.collect()) <= set(r.doc_id for r in three.collect())
    assert max(Counter(r.doc_id for r in four.collect()).values()) <= 2
    five = stage["sharding"](spark, four, path)
    assert five.columns == [*table.columns, "shard"] and five.count() == four.count()


def test_run_writes_between_stages(spark, tables):
    path, given, _ = tables
    out = C.run(spark, path)
    assert out.count() > 0 and out.where(F.col("shard").isNull()).count() == 0
    ids = {r.doc_id for r in out.collect()}
    assert not ids & {41, 42} and ids <= {r[0] for r in given}


def test_empty_tables(spark):
    path = scratch(spark, "pipeline")
    docs(spark, []).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert C.run(spark, path).count() == 0


def test_registration():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert C.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
