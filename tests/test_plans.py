"""Physical plans: pruning, pushdown, early cuts, no single-task step over large data."""

from pyspark.sql import functions as F

from daybook.operators import backlog as B
from daybook.operators import captures as C
from daybook.operators import keyword as KW
from daybook.operators import postings as P
from daybook.operators import states as S
from daybook.operators.throttle import throttle
from daybook.sources.store import ArchiveStore
from tests.helpers import captures, docs, plan, states


def stored(spark, folder, df):
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def test_anti_join_reads_only_paths(spark, folder):
    d = stored(spark, folder, docs(spark, [("a", "x"), ("b", "y")]))
    text = plan(B.pending_docs(d.select("path"), d.filter("path = 'a'")))
    assert "text" not in text and "PushedFilters: [IsNotNull(path), EqualTo(path,a)]" in text


def test_cap_is_top_k(spark):
    assert "TakeOrderedAndProject" in plan(B.capped_pending(docs(spark, [("a", "x")]), 1))


def test_query_words_are_filtered_before_grouping(spark, folder):
    d = stored(spark, folder, docs(spark, [("a", "x y"), ("b", "y")]))
    q = spark.createDataFrame([(1, "y")], "query_id long, text string")
    text = plan(KW.postings_match(P.build_postings(d, positions=False), KW.query_terms(q)))
    tree = text[: text.index("\n\n")]
    assert tree.index("HashAggregate") < tree.index("Exchange") < tree.index("BroadcastHashJoin LeftSemi") < tree.index("Generate")


def test_term_lookup_prunes_buckets(spark, folder):
    store = ArchiveStore(spark, folder)
    P.build_keyword_index(store, docs(spark, [("a", "x y"), ("b", "y")]))
    terms = spark.createDataFrame([("y",)], "term string")
    assert "dynamicpruning" in plan(P.live_postings(store, terms))


def test_no_single_partition_over_captures(spark):
    caps = captures(spark, [("a", i, i, "x") for i in range(5)])
    st = states(spark, [("a", 1, 1, "lock", True)])
    for df in (C.drop_unchanged(caps), S.asof_state(caps, st), S.pause_intervals(st), throttle(caps, ["window_id"])):
        assert "SinglePartition" not in plan(df)


def test_slices_split_a_key(spark):
    text = plan(C.drop_unchanged(captures(spark, [("a", 1, 1, "x")])))
    assert "hashpartitioning(window_id" in text and "_slice" in text


def test_long_exclusion_lists_join_on_runs(spark):
    terms = spark.createDataFrame([("bank",), ("x",), ("ab",)], "term string")
    caps = captures(spark, [("a", i, i, "h", t) for i, t in enumerate(["My BANK", "ban k", "aXa", "a b", "cab", ""])])
    kept = C.exclude_titles(caps, terms)
    assert "NestedLoop" not in plan(kept) and "Cartesian" not in plan(kept)
    assert sorted(r.title for r in kept.collect()) == ["", "a b", "ban k"]
    assert kept.filter(F.col("title").isNull()).count() == 0


def test_a_cycle_opens_only_the_days_of_new_documents(spark, folder):
    from daybook.operators.embed import default_encoder
    from daybook.plans.cycle import run_cycle

    rows = docs(spark, [("a", "x y", 0), ("b", "y", 10), ("c", "z", 86_400 * 3)])
    rows.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{folder}/docs")
    d, store, encoder = spark.read.parquet(f"{folder}/docs"), ArchiveStore(spark, f"{folder}/store"), default_encoder(8)
    run_cycle(store, d.filter("path <> 'c'"), encoder)
    text = plan(B.of_their_days(d, d.filter("path = 'c'")))
    assert "PartitionFilters: [isnotnull(day" in text and "2024-01-04" in text and "2024-01-01" not in text
    assert run_cycle(store, d, encoder).added == 1
