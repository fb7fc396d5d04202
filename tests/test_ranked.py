import random
import re

import pytest
from pyspark.sql import functions as F

from daybook.operators import keyword as KW
from daybook.operators import postings as P
from daybook.operators import ranked as R
from daybook.operators import refine as RF
from daybook.sources.store import ArchiveStore
from tests.helpers import docs, plan, values

WORDS = [f"w{i}" for i in range(40)] + ["common", "every"]


def sample(seed, n=120):
    rnd = random.Random(seed)
    rows = [(f"p{i:03d}", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 40)) + ["every"] * rnd.randint(0, 3))) for i in range(n)]
    return [*rows, ("empty", ""), ("null", None)]


def asked(spark, seed, n=12):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 3)))) for i in range(n)]
    return spark.createDataFrame([*rows, (90, "every common"), (91, "every"), (92, "unknown every"), (93, "")], "query_id long, text string")


def full(spark, rows, queries, k, optional=None):
    d = docs(spark, rows)
    return values(KW.keyword_search(P.build_postings(d, positions=False), P.doc_lengths(d), queries, k, optional=optional), "query_id", "rank", "path", "score")


def ranked(store, queries, k, **options):
    return values(R.ranked_search(store, queries, k, **options), "query_id", "rank", "path", "score")


@pytest.mark.parametrize(("seed", "k"), [(1, 3), (2, 10)])
def test_rows_equal_a_full_ranking(spark, folder, monkeypatch, seed, k):
    monkeypatch.setattr(R, "BLOCK", 4)
    monkeypatch.setattr(R, "SEEDS", 2)
    rows, queries = sample(seed), asked(spark, seed)
    store = ArchiveStore(spark, f"{folder}/store")
    R.build_ranked_index(store, docs(spark, rows))
    assert ranked(store, queries, k) == full(spark, rows, queries, k)
    more = asked(spark, seed + 50)
    assert ranked(store, queries, k, optional=more) == full(spark, rows, queries, k, more)


def test_changed_and_removed_documents(spark, folder, monkeypatch):
    """Three batches: counts, lengths and hits are those of the present archive alone; a repeated batch changes nothing."""
    monkeypatch.setattr(R, "BLOCK", 4)
    rows, queries = sample(7, 60), asked(spark, 7)
    store = ArchiveStore(spark, f"{folder}/store")
    R.build_ranked_index(store, docs(spark, rows))
    second = [(p, f"{t} common w1", 50) if i % 5 == 0 else (p, t, 0) for i, (p, t) in enumerate(rows[10:])] + [("new", "w1 w2 every", 60)]
    third = [(p, "w3 every", 90) if p in ("p015", "new") else (p, t, m) for p, t, m in second if p != "p020"] + [("p001", "w1 back every", 95)]
    for batch, now in ((1, second), (2, third), (2, third)):
        R.update_ranked_index(store, docs(spark, now), batch)
        texts = [(p, t) for p, t, _ in now]
        assert ranked(store, queries, 10) == full(spark, texts, queries, 10)
        d = docs(spark, texts)
        want = {(r.term, r.df) for r in P.term_statistics(P.build_postings(d, positions=False)).collect()}
        everything = spark.createDataFrame([(w,) for w in [*WORDS, "back"]], "term string")
        assert {tuple(r) for r in R.document_frequencies(store, everything, list(range(R.BUCKETS))).collect()} == want
        n, mean = R.corpus_counts(store)
        lengths = [len(t.split()) for _, t in texts if t is not None]
        assert (n, round(mean, 9)) == (len(texts), round(sum(lengths) / len(lengths), 9))
    assert values(R.live_documents(store), "path") == sorted(p for p, _, _ in third)


def test_only_needed_buckets_and_blocks_are_opened(spark, folder, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 8)
    monkeypatch.setattr(R, "SEEDS", 1)
    rnd = random.Random(3)
    # One block's documents name the word often and briefly, so no other block can come near them.
    rows = [(f"p{i:04d}", "word " + " ".join(rnd.choices(WORDS, k=60))) for i in range(600)] + [(f"best{i}", "word word word") for i in range(3)]
    store = ArchiveStore(spark, f"{folder}/store")
    R.build_ranked_index(store, docs(spark, rows))
    queries = spark.createDataFrame([(1, "word")], "query_id long, text string")
    trace = R.Trace()
    assert ranked(store, queries, 1, trace=trace) == full(spark, rows, queries, 1)
    heads, opened = trace.heads.filter("term = 'word'").count(), sum(r.count() for r in trace.rounds)
    assert heads >= 64 and opened <= heads / 4
    assert len(trace.buckets) == 1
    scan = plan(store.read("blocks").filter(R.F.col("bucket").isin(trace.buckets)).select("term", "block", "max_tf"))
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan
    assert "entries" not in scan.partition("ReadSchema")[2].partition("\n")[0]


def test_feedback_equals_the_one_over_postings(spark, folder):
    rows, queries = sample(5), asked(spark, 5)
    store = ArchiveStore(spark, f"{folder}/store")
    d = docs(spark, rows)
    R.build_ranked_index(store, d)
    want = RF.refine_queries(P.build_postings(d, positions=False), P.doc_lengths(d), queries)
    assert values(R.refine_from_store(store, queries), "query_id", "text") == values(want, "query_id", "text")
    top = spark.createDataFrame([("p001",), ("p002",)], "path string")
    looked_up = plan(R.terms_of(store, top))
    assert "/blocks/" not in looked_up and "/postings/" not in looked_up and "/forward/" in looked_up
    assert values(R.terms_of(store, top), "path") == ["p001", "p002"]


def test_an_empty_archive(spark, folder):
    store = ArchiveStore(spark, f"{folder}/store")
    R.build_ranked_index(store, docs(spark, [("x", "y")]).limit(0))
    assert ranked(store, asked(spark, 1), 5) == []


def test_blocks_are_built_by_one_shuffle(spark, folder, monkeypatch):
    plans, append = {}, ArchiveStore.append
    monkeypatch.setattr(ArchiveStore, "append", lambda self, table, df, batch: (plans.update({table: plan(df)}), append(self, table, df, batch))[1])
    R.build_ranked_index(ArchiveStore(spark, folder), docs(spark, [(f"d{i:03d}", f"all w{i % 7}", i) for i in range(300)]))
    assert plans["blocks"].count("\nArguments: hashpartitioning") == 1


def test_terms_of_several_blocks_by_a_shuffle_join(spark, folder, monkeypatch):
    rows = [(f"d{i:03d}", f"all w{i % 7}" if i % 50 else None, i) for i in range(300)]
    monkeypatch.setattr(R, "CELL_POSTINGS", 5)
    found = {}
    for most in (1_000_000, 0):
        monkeypatch.setattr(R, "LEVELLED_ROWS", most)
        store = ArchiveStore(spark, f"{folder}/{most}")
        R.build_ranked_index(store, docs(spark, rows))
        blocks = store.read("blocks")
        assert {r.level for r in blocks.filter("term = 'all'").select("level").distinct().collect()} == {2}
        found[most] = values(blocks.select("term", "level", F.inline("entries")), "term", "level", "path", "tf", "len")
        assert store.read("forward").filter("len IS NULL AND size(terms) = 0").count() == 6
    want = sorted((t, 2 if t == "all" else 0, p, 1, 2) for p, x, _ in rows if x for t in x.split())
    assert found[0] == found[1_000_000] == want


def test_texts_of_a_fresh_index_are_not_joined(spark, folder, monkeypatch):
    plans, append = {}, ArchiveStore.append
    monkeypatch.setattr(ArchiveStore, "append", lambda self, table, df, batch: (plans.update({table: plan(df)}), append(self, table, df, batch))[1])
    monkeypatch.setattr(R, "QUERY_TERM_ROWS", 10)
    rows = [(f"d{i:03d}", f"all w{i % 7}", i) for i in range(30)] + [(None, "no path", 0)]
    store = ArchiveStore(spark, folder)
    R.build_ranked_index(store, docs(spark, rows))
    assert "Join" not in plans["forward"]
    assert values(R.live_documents(store), "path") == [p for p, _, _ in rows[:-1]]


def test_blocks_of_several_rounds(spark, folder, monkeypatch):
    rows = [(f"d{i:03d}", f"all w{i % 7} v{i % 31}", i) for i in range(300)]
    found = []
    for most in (10_000, 100, 1):
        monkeypatch.setattr(R, "ROUND_POSTINGS", most)
        store = ArchiveStore(spark, f"{folder}/{most}")
        for _ in range(2):  # a repeated batch replaces all of its rounds
            R.update_ranked_index(store, docs(spark, rows), 0)
        assert store.counts("blocks").rows == store.read("blocks").count()
        found.append(values(store.read("blocks").select("term", "level", "block", "max_tf", F.inline("entries")), "term", "level", "block", "max_tf", "hash", "path", "tf", "len"))
    assert found[0] == found[1] == found[2] and len(found[0]) == 900


@pytest.mark.parametrize("few", [0, 31_250])
def test_many_candidates_are_looked_up_by_path(spark, folder, monkeypatch, few):
    monkeypatch.setattr(R, "BLOCK", 4)
    monkeypatch.setattr(R, "SEEDS", 2)
    monkeypatch.setattr(R, "FEW", few)
    rows, queries = sample(7), asked(spark, 7)
    store = ArchiveStore(spark, f"{folder}/store")
    R.build_ranked_index(store, docs(spark, rows))
    hits = R.ranked_search(store, queries, 3, optional=asked(spark, 8))
    assert values(hits, "query_id", "rank", "path", "score") == full(spark, rows, queries, 3, asked(spark, 8))
    # The lists of postings themselves are never dealt out.
    assert not re.search(r"Exchange\nInput \[\d+\]: \[[^\n]*entries", plan(hits))


def test_shuffle_files_of_an_index_are_removed(spark, folder):
    """They go when a job has ended, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(key), []
    with R.freed_shuffles(spark):
        seen.append(spark.conf.get(key))
    assert seen == ["true"] and spark.conf.get(key) == before
