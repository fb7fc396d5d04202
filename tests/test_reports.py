import pytest
from pyspark.sql import functions as F

from daybook.operators import reports as RP
from daybook.operators import retention as R
from daybook.runtime import broadcast_if_small, fits, remove_dirs, scratch, shared_dir
from daybook.sources import files, logs
from daybook.sources.counts import Counts, kept
from daybook.sources.raw import read_files, write_files
from daybook.sources.store import ArchiveStore
from tests.helpers import at, docs, plan, utc, values

LINES = [
    "2024-01-01 10:00:00,120 - indexer - INFO - Index cycle done: Added 3 files in 1.5 seconds. Index size: 3 vectors.",
    "2024-01-01 11:00:00,000 - indexer - ERROR - Failed to flush a batch",
    "Traceback (most recent call last):",
    "  File x, line 1 - in - INFO - y",
    "2024-01-02 09:00:00,999 - indexer - INFO - Flushed batch of 64 files. Total indexed now 64.",
    "2024-01-02 09:00:01,000 - daemon - INFO - Index cycle done - a - b",
    "2024-01-02 10:00:00,000 - indexer - INFO - Index cycle done: Added 61 non-empty files (out of 64 discovered) in 2.0 seconds. Index size: 64 vectors.",
]
MARKS = ["Index cycle done", "indexer"]


def log_table(spark, lines=LINES):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string")


def test_log_parsing(spark):
    rows = {r.line_no: r for r in logs.parse_logs(log_table(spark)).collect()}
    assert rows[0].level == "INFO" and rows[0].logger == "indexer" and rows[0].ts.microsecond == 120000
    assert rows[2].ts is None and rows[3].level is None
    assert rows[5].message == "Index cycle done - a - b"


def test_log_lines_keep_file_order_over_many_splits(spark, folder):
    old, new = [f"old {i} " + "x" * (i % 70) for i in range(900)], [f"new {i}" for i in range(200)]
    for name, lines in (("a.log", old), ("b.log", new)):
        spark.createDataFrame([("\n".join(lines),)], "c string").select(
            F.lit(name).alias("name"), F.encode("c", "UTF-8").alias("content")
        ).transform(lambda d: write_files(d, folder) or d)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = logs.read_logs(spark, folder).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in got] == old + new and [r.line_no for r in got] == list(range(1100))


def test_last_run_tail_and_search(spark):
    table = log_table(spark)
    assert RP.last_successful_run(table, MARKS).first().last_run == "2024-01-02 10:00:00"
    assert RP.last_successful_run(table.filter("line_no < 6"), MARKS).first().last_run == "2024-01-01 10:00:00"
    assert RP.last_successful_run(table.limit(0), MARKS).first().last_run == "Pending"
    assert [r.line_no for r in RP.log_tail(table, 3).collect()] == [4, 5, 6]
    assert values(RP.log_contains_all(table, MARKS), "line_no") == [0, 6]


def test_cycle_history(spark):
    got = RP.cycle_history(logs.parse_logs(log_table(spark))).withColumn("day", F.col("day").cast("string"))
    assert values(got, "day", "cycles", "added", "discovered", "seconds", "flushes", "flushed") == [
        ("2024-01-01", 1, 3, 3, 1.5, 0, 0), ("2024-01-02", 1, 61, 64, 2.0, 1, 64),
    ]


def test_index_stats(spark):
    d = docs(spark, [("a", "x", 0), ("b", "x", 10), ("c", "x", 20)])
    gone = spark.createDataFrame([("a", at(5)), ("z", at(6)), ("y", at(7)), ("w", at(8))], "path string, indexed_at timestamp")
    row = RP.vector_index_stats(d, gone).first()
    assert (row.processed, row.pending_reported, row.pending_exact, row.last_run) == (4, 0, 2, at(8))
    row = RP.vector_index_stats(d, gone, enabled=False).first()
    assert not row.enabled and row.processed is None
    files_ = spark.createDataFrame([(at(10),), (at(3),)], "mtime timestamp")
    row = RP.keyword_index_stats(d, files_).first()
    assert (row.processed, row.pending_reported, row.last_run) == (2, 1, at(10))
    row = RP.keyword_index_stats(d, files_.limit(0)).first()
    assert (row.processed, row.pending_reported, row.last_run) == (0, 3, None)


def test_empty_archive(spark):
    none = docs(spark, [("a", "x")]).limit(0)
    row = RP.corpus_stats(none).first()
    assert (row.n_docs, row.total_bytes, row.size_text, row.count_text) == (0, 0, "0.00 MB", "0")
    assert R.sample_for_dry_run(none).first().n_files == 0
    assert values(RP.dir_sizes(none.withColumn("area", F.lit("texts")), ["texts", "index"]), "area", "mib") == [("index", 0.0), ("texts", 0.0)]


def test_status_shows_disabled_backends(spark):
    d = docs(spark, [("a", "x" * 1048576, 0)])
    samples = spark.createDataFrame(
        [(at(0), 1, "python Engine.py", 1.5, 1048576, 2048, 1024), (at(0), 2, "python engine.py", 9.0, 1, 1, 1)],
        "sample_ts timestamp, pid long, cmdline string, cpu double, rss long, io_read long, io_write long",
    )
    vectors = spark.createDataFrame([("a", at(0))], "path string, indexed_at timestamp")
    now = F.lit(utc(23 * 3600 + 59 * 60)).cast("timestamp")
    row = RP.archive_status(d, vectors, d.select("mtime"), samples, ["Engine"], now, keyword_enabled=False).first()
    assert row.keyword_processed == "Disabled" and row.keyword_last_run == "N/A" and row.vector_processed == "1"
    assert (row.cpu_pct, row.mem_mib, row.read_kib, row.db_mib) == (1.5, 1.0, 2.0, 1.0)
    assert row.next_update == "~ 00:00" and row.next_run == "2024-01-02 00:00:00"


def test_recent_captures_and_latest(spark):
    d = docs(spark, [("b", "xx", 5), ("a", "x", 5), ("c", "x", 1)])
    assert [r.path for r in RP.recent_captures(d, 2).collect()] == ["a", "b"]
    assert values(R.latest_record(d), "path") == ["a", "b"] and values(R.delete_latest(d), "path") == ["c"]


# -- files -------------------------------------------------------------------------------------


def test_read_texts_from_a_folder(spark, folder):
    rows = [("w_1704067200.txt", b"a\r\nb"), ("w_1704067201.txt", b"\xff"), ("w_1704067200.png", b"png")]
    write_files(spark.createDataFrame(rows, "name string, content binary"), folder)
    got = files.read_texts(spark, folder).collect()
    assert [(r.window_id, r.text, r.ts) for r in got] == [("w", "a\nb", at(0))]
    assert files.file_inventory(spark, folder).count() == 3 and files.read_captures(spark, folder).count() == 1
    assert "content" not in plan(files.file_inventory(spark, folder)).split("ReadSchema")[1]


def test_id_map_of_another_shape_is_empty(spark, folder):
    rows = [("a.json", b'["x", "y"]'), ("b.json", b'{"x": 1}'), ("c.json", b"oops")]
    write_files(spark.createDataFrame(rows, "name string, content binary"), folder)
    assert values(files.read_id_map(spark, f"{folder}/a.json"), "id", "path") == [(0, "x"), (1, "y")]
    assert files.read_id_map(spark, f"{folder}/b.json").count() == 0
    assert files.read_id_map(spark, f"{folder}/c.json").count() == 0


def test_checked_broadcast(spark):
    df = spark.range(10)
    assert fits(df, 10) and not fits(df, 9)
    big = spark.range(1000).withColumn("k", F.col("id") % 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(big.join(broadcast_if_small(df.withColumnRenamed("id", "k"), 10), "k"))
        assert "SortMergeJoin" in plan(big.join(broadcast_if_small(df.withColumnRenamed("id", "k"), 9), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scratch_follows_the_session_setting(spark):
    one, two = scratch(spark, "x"), scratch(spark, "x")
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert one != two and all(p.startswith(named or shared_dir(spark)) for p in (one, two))


def test_counters_follow_what_happens_to_batches(spark, tmp_path):
    store = ArchiveStore(spark, str(tmp_path / "counted"))
    assert store.counts("texts") == Counts()
    d = docs(spark, [("a", "x", 0), ("b", "xx", 10), ("c", "xyz", 20)]).withColumn("day", F.to_date("mtime"))
    us = lambda t: round(utc(t).timestamp() * 1_000_000)
    store.append("texts", d.limit(0), 0)
    store.append("texts", d, 1)
    store.append("texts", d.filter("path = 'c'"), 2)
    whole = store.counts("texts")
    assert (whole.rows, whole.bytes, whole.oldest, whole.newest) == (4, 9, us(0), us(20))
    assert store.counts("texts", above=utc(10)).rows == 2 and store.counts("texts", above=utc(20)).rows == 0
    store.append("texts", d.filter("path <> 'c'"), 2)
    assert store.counts("texts").rows == 5
    # A batch without counters is counted, and so are the rows that a cutoff leaves.
    folder = store.head("texts").location
    remove_dirs(spark, [f"{folder}/batch=1/_counts.json"])
    assert store.counts("texts").rows == 5
    store.retain("texts", utc(10))
    assert store.counts("texts").rows == 3
    store.reset("texts")
    assert store.counts("texts") == Counts()


def test_rewritten_batches_lose_their_counters(spark, tmp_path):
    store = ArchiveStore(spark, str(tmp_path / "skips"))
    rows = spark.createDataFrame([(f"p{i}", "blank") for i in range(6)], "path string, reason string")
    for batch in (0, 1):
        store.append("skipped", rows, batch)
    store.rewrite_batches("skipped", [0], store.read("skipped").filter("batch = 0 AND path < 'p2'"))
    assert kept(spark, f"{store.head('skipped').location}/batch=0") is None and store.counts("skipped").rows == 8
    store.replace("skipped", store.read("skipped").filter("path = 'p0'"))
    assert store.counts("skipped").rows == 2


def test_stored_status_equals_scanned_status(spark, tmp_path):
    d = docs(spark, [(f"p{i}", "x" * i, i * 10) for i in range(12)])
    vectors = spark.createDataFrame([(i, f"p{i}", [1.0], 1, "e", at(i)) for i in range(5)], "id long, path string, vec array<float>, dim int, encoder string, indexed_at timestamp")
    samples = spark.createDataFrame([(at(0), 1, "run", 1.5, 10, 20, 30)], "sample_ts timestamp, pid long, cmdline string, cpu double, rss long, io_read long, io_write long")
    store, now = ArchiveStore(spark, str(tmp_path / "status")), F.lit(utc(500)).cast("timestamp")
    shown = lambda: RP.stored_status(store, samples, ["run"], now).collect()
    assert shown()[0].n_docs == 0 and shown()[0].keyword_last_run == "N/A"
    dated = d.withColumn("day", F.to_date("mtime"))
    split = F.lit(utc(45)).cast("timestamp")
    store.append("texts", dated.filter(F.col("mtime") < split), 0)
    store.append("texts", dated.filter(F.col("mtime") >= split), 1)
    store.append("vectors", vectors, 0)
    files_ = d.filter("size <= 7").select("mtime")
    stats = d.filter("size <= 7").select("path", F.lit(1).cast("long").alias("len"), "mtime", F.lit(False).alias("removed"), F.col("mtime").alias("indexed_at"))
    store.append("doc_stats", stats, 0)
    assert shown() == RP.archive_status(d, vectors, files_, samples, ["run"], now).collect()


def test_files_are_not_listed_on_the_driver(spark, folder):
    """The rows of Spark's binary files, with no file of the folder in the plan, and a number of tasks that follows from thousands of files."""
    names = [f"w_{1704067200 + i}.txt" for i in range(300)] + ["_hidden.txt", ".hidden.txt", "k=1.png", "a b%20c.txt", "_x=1_1704067200.txt"]
    write_files(spark.createDataFrame([(n, bytearray(n.encode() + b"\xff" * (i % 3))) for i, n in enumerate(names)], "name string, content binary"), folder)
    write_files(spark.createDataFrame([("below.txt", bytearray(b"x"))], "name string, content binary"), f"{folder}/deeper")
    for pattern in ("*", "*.txt", "*.none"):
        ours, theirs = read_files(spark, folder, pattern), spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        assert ours.columns == theirs.columns and sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))
    texts = files.read_texts(spark, folder)
    assert not any(f.endswith(".txt") for f in texts.inputFiles()) and texts.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(r.path for r in texts.select("path").collect()) == sorted(r.path for r in read_files(spark, folder, "*.txt").collect() if not r.content.endswith(b"\xff"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_texts(spark, f"{folder}/none").count()
