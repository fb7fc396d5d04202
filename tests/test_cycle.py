import pytest
from pyspark.sql import functions as F

from daybook.operators import backlog as B
from daybook.operators.embed import Encoder, default_encoder
from daybook.plans import cycle as CY
from daybook.plans import maintain as M
from daybook.plans.search import KEYWORD, SEMANTIC
from daybook.sources.store import ArchiveStore
from tests.helpers import at, docs, plan, utc, values

ENC = default_encoder(16)
ONLY = {"backends": (SEMANTIC,)}


def many(spark, n, blanks=0):
    return docs(spark, [(f"a{i:03d}", " \t") for i in range(blanks)] + [(f"d{i:03d}", f"text {i}") for i in range(n)])


def index(store):
    return values(CY.load_vector_index(store), "id", "path")


def test_pending_and_cap(spark):
    d, done = many(spark, 10), many(spark, 4)
    assert values(B.pending_docs(d, done), "path") == [f"d{i:03d}" for i in range(4, 10)]
    assert values(B.except_paths(d, done), "path") == values(B.pending_docs(d, done), "path")
    assert B.pending_docs(d, d).count() == 0 and B.pending_docs(d, d.limit(0)).count() == 10
    for cap, n in ((0, 10), (1, 1), (10, 10), (99, 10)):
        assert values(B.capped_pending(d, cap), "path") == [f"d{i:03d}" for i in range(n)]


def test_large_caps_use_the_distributed_ranking(spark, monkeypatch):
    monkeypatch.setattr(B, "TOP_K_ROWS", 3)
    assert values(B.capped_pending(many(spark, 20), 7), "path") == [f"d{i:03d}" for i in range(7)]


def test_ids_are_dense_in_code_point_order(spark):
    names = ["b", "B", "é", "a_2", "a_10", "z", "Z1", "ß"] + [f"k{i}" for i in range(500)]
    d = spark.createDataFrame([(n, "x") for n in names], "path string, text string").repartition(7)
    got = {r.path: r.id for r in B.assign_ids(d, 40).collect()}
    assert got == {p: 40 + i for i, p in enumerate(sorted(names))}
    packed = B.pack_batches(B.assign_ids(d, 40), 40, 64).groupBy("batch_no").count()
    assert values(packed, "batch_no", "count") == [(i, 64) for i in range(7)] + [(7, 508 - 448)]


def test_capped_cycles_equal_one_cycle(spark, folder):
    d = many(spark, 25, blanks=3)
    one, some = ArchiveStore(spark, folder + "/one"), ArchiveStore(spark, folder + "/some")
    report = CY.run_cycle(one, d, ENC, **ONLY)
    assert (report.discovered, report.added, report.index_size) == (25, 25, 25)
    sizes = [CY.run_cycle(some, d, ENC, cap=10, **ONLY).added for _ in range(4)]
    assert sizes == [10, 10, 5, 0] and index(some) == index(one)
    assert one.read("skipped").count() == 3
    # pending + indexed + skipped = total
    assert CY.pending_work(one, d)[1] + 25 + 3 == d.count()
    report = CY.cycle_report(some)
    assert values(report, "batch", "discovered", "added", "progress") == [(0, 25, 10, 40.0), (1, 15, 10, 66.7), (2, 5, 5, 100.0), (3, 0, 0, None)]


def test_blank_files_block_only_the_compatible_cycle(spark, folder):
    d = many(spark, 5, blanks=4)
    old, new = ArchiveStore(spark, folder + "/old"), ArchiveStore(spark, folder + "/new")
    assert [CY.run_cycle(old, d, ENC, cap=3, compat=True, **ONLY).added for _ in range(2)] == [0, 0]
    assert [CY.run_cycle(new, d, ENC, cap=3, **ONLY).added for _ in range(2)] == [3, 2]


def test_dry_run_and_toggles(spark, folder):
    store, d = ArchiveStore(spark, folder), many(spark, 5)
    report = CY.run_cycle(store, d, ENC, cap=2, dry_run=True)
    assert (report.discovered, report.queued, report.added) == (5, 2, 0)
    assert index(store) == [] and store.read("postings").count() == 0
    CY.run_cycle(store, d, ENC, backends=(KEYWORD,))
    assert index(store) == [] and store.read("postings").count() == 10


def test_budget_stops_after_the_current_batch(spark, folder):
    ticks = iter(range(100))
    store = ArchiveStore(spark, folder)
    CY.run_cycle(store, many(spark, 20), ENC, batch_docs=5, budget_s=1.5, clock=lambda: next(ticks), **ONLY)
    assert len(index(store)) == 10


def failing(on):
    calls = [0]

    def encode(text):
        calls[0] += 1
        if calls[0] in on:
            raise RuntimeError("lost")
        return ENC.encode(text)

    return Encoder(ENC.name, ENC.dim, encode)


def test_failed_batch_is_left_pending_and_ids_stay_dense(spark, folder):
    store, d = ArchiveStore(spark, folder), many(spark, 12)
    report = CY.run_cycle(store, d, failing({2}), batch_docs=4, **ONLY)
    assert (report.added, report.failed_batches) == (8, 1)
    assert values(store.read("dead_letters"), "path", "error") == [(f"d{i:03d}", "lost") for i in range(4, 8)]
    CY.run_cycle(store, d, ENC, **ONLY)
    got = index(store)
    assert [i for i, _ in got] == list(range(12)) and len({p for _, p in got}) == 12


def test_cycle_raises_if_no_batch_gets_through(spark, folder):
    store, d = ArchiveStore(spark, folder), many(spark, 6)
    with pytest.raises(RuntimeError, match="all 2 batches"):
        CY.run_cycle(store, d, failing({1, 2}), batch_docs=3, **ONLY)
    assert store.read("dead_letters").count() == 6
    assert CY.run_cycle(store, d, ENC, **ONLY).added == 6


def test_undecodable_files_are_reported_and_stay_pending(spark, folder):
    from daybook.sources.files import read_texts_and_rejects
    from daybook.sources.raw import write_files

    data = [("w_1704067200.txt", b"fine"), ("w_1704067201.txt", b"\xff\xfe")]
    write_files(spark.createDataFrame([(n, bytearray(c)) for n, c in data], "name string, content binary"), f"{folder}/raw")
    texts, rejects = read_texts_and_rejects(spark, f"{folder}/raw")
    store = ArchiveStore(spark, f"{folder}/store")
    for _ in range(2):
        CY.run_cycle(store, texts, ENC, rejects=rejects, **ONLY)
    assert len(index(store)) == 1 and store.read("skipped").count() == 0
    assert {(p.rpartition("/")[2], e) for p, e in values(store.read("dead_letters"), "path", "error")} == {("w_1704067201.txt", "undecodable")}


def test_cluster_sessions_need_a_shared_folder():
    from types import SimpleNamespace

    from daybook.runtime import shared_dir

    nothing = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: nothing, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=nothing))


def test_repeating_a_batch_does_not_duplicate(spark, folder):
    from daybook.streaming.index import index_batch

    store, d = ArchiveStore(spark, folder), many(spark, 6, blanks=1)
    index_batch(store, d.filter("path < 'd003'"), ENC, 0)
    for _ in range(3):  # a crash after the write repeats the micro-batch
        index_batch(store, d.filter("path >= 'd003'"), ENC, 1)
    assert index(store) == [(i, f"d{i:03d}") for i in range(6)]
    assert store.read("skipped").count() == 1


def test_other_encoder_is_refused(spark, folder):
    store, d = ArchiveStore(spark, folder), many(spark, 3)
    CY.run_cycle(store, d.limit(1), ENC, **ONLY)
    with pytest.raises(ValueError, match="hashed-tf-16"):
        CY.run_cycle(store, d, default_encoder(8), **ONLY)


def test_changed_documents_are_not_embedded_again(spark, folder):
    store = ArchiveStore(spark, folder)
    CY.run_cycle(store, docs(spark, [("a", "one", 0)]), ENC, **ONLY)
    assert CY.run_cycle(store, docs(spark, [("a", "two", 99)]), ENC, **ONLY).added == 0
    changed = B.changed_docs(docs(spark, [("a", "two", 99), ("b", "x", 1), ("c", "y", 1)]), docs(spark, [("a", "one", 0), ("c", "y", 1)]))
    assert values(changed, "path") == ["a", "b"]


# -- maintenance -------------------------------------------------------------------------------

DAY = 86400


def archive(spark, folder, rows):
    store = ArchiveStore(spark, folder)
    day = F.to_date("mtime")
    store.append("texts", docs(spark, rows).withColumn("day", day), 0)
    store.append("frames", docs(spark, rows).withColumn("path", F.concat("path", F.lit(".png"))).withColumn("day", day), 0)
    return store


AGED = [("now.txt", "x", 30 * DAY), ("edge.txt", "x", 20 * DAY), ("older.txt", "x", 20 * DAY - 0.000001), ("old.txt", "x", 19 * DAY), ("oldest.txt", "x", 0)]


def test_retention_is_strict_and_prunes(spark, folder):
    store = archive(spark, folder, AGED)
    report = M.apply_retention(store, utc(30 * DAY), 10, dry_run=True).first()
    assert (report.n_files, report.n_more) == (6, 1) and report["sample"][0] == "old.txt" and store.read("texts").count() == 5
    M.apply_retention(store, utc(30 * DAY), 10)
    assert values(store.read("texts"), "path") == ["edge.txt", "now.txt"]
    assert values(store.read("frames"), "path") == ["edge.txt.png", "now.txt.png"]
    days = {f.split("day=")[1][:10] for f in spark.read.parquet(store.head("texts").location).inputFiles()}
    assert days == {"2024-01-20", "2024-01-21", "2024-01-31"}  # whole expired days are gone from disk
    text = plan(store.read("texts"))
    assert "PartitionFilters: [isnotnull(day" in text
    # A shorter period later never brings rows back, nor does a longer one.
    M.apply_retention(store, utc(30 * DAY), 25)
    assert store.read("texts").count() == 2
    M.apply_retention(store, utc(30 * DAY), 5)
    assert values(store.read("texts"), "path") == ["now.txt"]


@pytest.mark.parametrize("days, kept", [(9, ["now.txt"]), (10, ["edge.txt", "now.txt", "older.txt"]), (11, ["edge.txt", "now.txt", "old.txt", "older.txt"])])
def test_whole_day_policy(spark, folder, days, kept):
    from daybook.operators.retention import expired_whole_days

    store = archive(spark, folder, AGED)
    d = docs(spark, AGED)
    doomed = set(values(expired_whole_days(d, utc(30 * DAY), days), "path"))
    assert sorted({r[0] for r in AGED} - doomed) == kept
    CY.run_cycle(store, d, ENC, **ONLY)
    M.retain_then_reset(store, utc(30 * DAY), days)
    assert values(store.read("texts"), "path") == kept and index(store) == []


def test_reconcile_touches_only_affected_batches(spark, folder):
    store, d = ArchiveStore(spark, folder), many(spark, 9)
    CY.run_cycle(store, d, ENC, batch_docs=3, **ONLY)
    left = d.filter("path NOT IN ('d000', 'd001', 'd002', 'd004')")
    head = store.head("vectors").location
    untouched = {f for f in store.read("vectors").inputFiles() if "batch=2" in f}
    assert M.reconcile_index(store, left, dry_run=True).first().n_orphans == 4 and len(index(store)) == 9
    M.reconcile_index(store, left)
    assert [p for _, p in index(store)] == ["d003", "d005", "d006", "d007", "d008"]
    assert untouched <= set(store.read("vectors").inputFiles()) and store.head("vectors").location == head
    assert M.reconcile_index(store, left).first().n_orphans == 0
    # Ids go on after the greatest one.
    CY.run_cycle(store, left.unionByName(docs(spark, [("e", "new")])), ENC, **ONLY)
    assert index(store)[-1] == (9, "e")


def test_delete_latest_reset_and_rebuild(spark, folder):
    store, d = ArchiveStore(spark, folder), many(spark, 4)
    assert M.reset_vector_index(store) == []
    CY.run_cycle(store, d, ENC, **ONLY)
    assert values(M.delete_latest_vector(store, dry_run=True), "path") == ["d003"] and len(index(store)) == 4
    M.delete_latest_vector(store)
    assert [i for i, _ in index(store)] == [0, 1, 2]
    assert M.reset_vector_index(store, dry_run=True) == ["vectors"] and len(index(store)) == 3
    M.clear_index(store)
    assert index(store) == []
    report = M.full_rebuild(store, d, ENC, **ONLY)
    assert report.added == 4 and [i for i, _ in index(store)] == [0, 1, 2, 3]
    assert values(store.history("vectors"), "version", "op") == [(1, "create"), (2, "reset"), (3, "reset")]


def test_snapshot_round_trip_backup_and_checks(spark, folder):
    store, d = ArchiveStore(spark, folder + "/a"), many(spark, 6)
    CY.run_cycle(store, d, ENC)
    path = M.export_snapshot(store, folder + "/out", utc(0))
    assert path.endswith("snapshot=20240101_000000")
    other = ArchiveStore(spark, folder + "/b")
    CY.run_cycle(other, d.limit(2), ENC)
    before = other.head("vectors").location
    assert M.import_snapshot(other, path, dry_run=True) and len(index(other)) == 2
    assert M.import_snapshot(other, path) and index(other) == index(store)
    assert other.read("postings").count() == store.read("postings").count()
    assert spark.read.parquet(before).count() == 2  # the backup
    assert not M.import_snapshot(other, folder + "/nowhere")
    store.read("vectors").limit(1).write.mode("append").parquet(f"{path}/vectors")
    with pytest.raises(ValueError, match="manifest"):
        M.import_snapshot(other, path)


def test_two_writers_cannot_commit_the_same_version(spark, folder):
    store = ArchiveStore(spark, folder)
    store._commit("vectors", f"{folder}/x", "create")
    stale = store.head("vectors")
    store.head = lambda table: None if table == "vectors" else stale
    with pytest.raises(Exception, match="exists"):
        store._commit("vectors", f"{folder}/y", "create")
