"""Retention, orphans, resets, rebuilds and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.neighbours import ENCODER
from catalog.registry import register
from daybook.operators import retention as R
from daybook.plans import cycle as CY
from daybook.plans import maintain as M
from daybook.plans.search import SEMANTIC
from daybook.runtime import scratch
from daybook.sources.store import ArchiveStore

DAYS = 20
CUTOFF = f"{X.NOW_SQL} - INTERVAL {DAYS} DAY"
# The whole-day rule: more than DAYS full days old.
WHOLE = f"floor(epoch({X.NOW_SQL} - mtime) / 86400) > {DAYS}"


@register("retention_cutoff", f"WITH {X.DOCS} SELECT path FROM docs WHERE mtime < {CUTOFF}")
def _(spark, sf):
    return R.expired(X.docs(spark, sf), X.NOW, DAYS).select("path")


@register("retention_whole_days", f"WITH {X.FRAMES} SELECT path FROM frames WHERE {WHOLE}")
def _(spark, sf):
    return R.expired_whole_days(X.frame_files(spark, sf), X.NOW, DAYS).select("path")


AREAS = f"""{X.DOCS}, {X.FRAMES}, files AS (SELECT 'texts' AS area, path, mtime, size FROM docs
  UNION ALL SELECT 'frames', path, mtime, size FROM frames)"""


def _files(spark, sf):
    return R.files_of_areas({"texts": X.docs(spark, sf), "frames": X.frame_files(spark, sf)})


@register("files_of_areas", f"WITH {AREAS} SELECT area, path, epoch_us(mtime) AS mtime_us, size FROM files")
def _(spark, sf):
    return _files(spark, sf).select("area", "path", X.us("mtime").alias("mtime_us"), "size")


@register(
    "sample_for_dry_run",
    f"""WITH {AREAS}, old AS (SELECT path FROM files WHERE mtime < {CUTOFF})
    SELECT count(*) AS n_files, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM old ORDER BY path LIMIT 5)) AS sample,
    greatest(count(*) - 5, 0) AS n_more FROM old""",
)
def _(spark, sf):
    report = R.sample_for_dry_run(R.expired(_files(spark, sf), X.NOW, DAYS))
    sample = F.nullif(F.array_join("sample", ","), F.lit(""))
    return report.select("n_files", sample.alias("sample"), "n_more")


def _archive(spark, sf):
    store = ArchiveStore(spark, scratch(spark, "archive"))
    day = F.to_date("mtime")
    store.append("texts", X.docs(spark, sf).drop("doc_id").withColumn("day", day).repartition("day"), 0)
    store.append("frames", X.frame_files(spark, sf).withColumn("day", day).repartition("day"), 0)
    return store


def _kept(store):
    return R.files_of_areas({a: store.read(a) for a in M.AREAS}).select("area", "path")


@register("apply_retention", f"WITH {AREAS} SELECT area, path FROM files WHERE mtime >= {CUTOFF}")
def _(spark, sf):
    store = _archive(spark, sf)
    M.apply_retention(store, X.NOW, DAYS)
    return _kept(store)


@register(
    "retain_then_reset",
    f"WITH {AREAS} SELECT area, path, 0::BIGINT AS n_vectors FROM files WHERE NOT {WHOLE}",
)
def _(spark, sf):
    store = _archive(spark, sf)
    store.replace("vectors", X.vectors(spark, sf))
    M.retain_then_reset(store, X.NOW, DAYS)
    n = store.read("vectors").agg(F.count(F.lit(1))).scalar()
    return _kept(store).withColumn("n_vectors", n)


# A quarter of the documents is gone.
LEFT = f"{X.VECTORS}, present AS (SELECT path FROM docs WHERE doc_id % 4 <> 1)"


def _present(spark, sf):
    return X.docs(spark, sf).filter("doc_id % 4 <> 1")


@register("orphan_vectors", f"WITH {LEFT} SELECT id, path FROM vectors WHERE path NOT IN (SELECT path FROM present)")
def _(spark, sf):
    return R.orphan_vectors(X.vectors(spark, sf), _present(spark, sf)).select("id", "path")


def _vector_store(spark, sf):
    store = ArchiveStore(spark, scratch(spark, "vectors"))
    store.replace("vectors", X.vectors(spark, sf))
    return store


@register("reconcile_index", f"WITH {LEFT} SELECT id, path FROM vectors WHERE path IN (SELECT path FROM present)")
def _(spark, sf):
    store = _vector_store(spark, sf)
    M.reconcile_index(store, _present(spark, sf))
    return store.read("vectors").select("id", "path")


@register("latest_record", f"WITH {X.DOCS} SELECT path, size FROM docs WHERE ts = (SELECT max(ts) FROM docs)")
def _(spark, sf):
    return R.latest_record(X.docs(spark, sf)).select("path", "size")


@register("delete_latest", f"WITH {X.VECTORS} SELECT id, path FROM vectors WHERE id < (SELECT max(id) FROM vectors)")
def _(spark, sf):
    store = _vector_store(spark, sf)
    M.delete_latest_vector(store)
    return store.read("vectors").select("id", "path")


@register("reset_vector_index", "SELECT count(*) AS n_before, 0::BIGINT AS n_after, 2::BIGINT AS n_versions FROM embeddings")
def _(spark, sf):
    store = _vector_store(spark, sf)
    before = store.read("vectors").agg(F.count(F.lit(1)).alias("n_before"))
    M.reset_vector_index(store)
    after = store.read("vectors").agg(F.count(F.lit(1))).scalar()
    versions = store.history("vectors").agg(F.count(F.lit(1))).scalar()
    return before.select("n_before", after.alias("n_after"), versions.alias("n_versions"))


@register(
    "clear_index",
    f"WITH {X.DOCS} SELECT path, row_number() OVER (ORDER BY path) - 1 AS id FROM docs",
)
def _(spark, sf):
    """After clearing, the next cycle starts again at id 0 and never meets an old vector."""
    store = _vector_store(spark, sf)
    M.clear_index(store)
    CY.run_cycle(store, X.docs(spark, sf), ENCODER, backends=(SEMANTIC,))
    return store.read("vectors").select("path", "id")


@register("full_rebuild", f"WITH {X.DOCS} SELECT path, row_number() OVER (ORDER BY path) - 1 AS id FROM docs")
def _(spark, sf):
    store = _vector_store(spark, sf)
    M.full_rebuild(store, X.docs(spark, sf), ENCODER, backends=(SEMANTIC,))
    return store.read("vectors").select("path", "id")


@register(
    "export_snapshot",
    "SELECT 'vectors' AS \"table\", count(*) AS n_rows FROM embeddings UNION ALL SELECT 'skipped', 0",
)
def _(spark, sf):
    store = _vector_store(spark, sf)
    target = M.export_snapshot(store, scratch(spark, "export"), X.NOW, ("vectors", "skipped"))
    return spark.read.schema("table string, n_rows long").json(f"{target}/manifest")


@register("import_snapshot", f"WITH {X.VECTORS} SELECT id, path, len(vec)::INTEGER AS dim FROM vectors")
def _(spark, sf):
    target = M.export_snapshot(_vector_store(spark, sf), scratch(spark, "export"), X.NOW, ("vectors",))
    other = ArchiveStore(spark, scratch(spark, "import"))
    other.replace("vectors", X.vectors(spark, sf).filter("id % 2 = 0"))
    M.import_snapshot(other, target)
    return other.read("vectors").select("id", "path", F.size("vec").alias("dim"))


@register(
    "dry_run",
    f"""WITH {LEFT}, {X.FRAMES}, files AS (SELECT mtime FROM docs UNION ALL SELECT mtime FROM frames)
    SELECT (SELECT count(*) FROM files WHERE mtime < {CUTOFF}) AS n_expired,
    (SELECT count(*) FROM vectors WHERE path NOT IN (SELECT path FROM present)) AS n_orphans,
    (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM vectors) AS n_vectors""",
)
def _(spark, sf):
    """Every destructive operation only reports; nothing changes."""
    store = _archive(spark, sf)
    store.replace("vectors", X.vectors(spark, sf))
    expired = M.apply_retention(store, X.NOW, DAYS, dry_run=True)
    orphans = M.reconcile_index(store, _present(spark, sf), dry_run=True).select("n_orphans").scalar()
    M.reset_vector_index(store, dry_run=True)
    M.delete_latest_vector(store, dry_run=True)
    files = _kept(store).agg(F.count(F.lit(1))).scalar()
    vectors = store.read("vectors").agg(F.count(F.lit(1))).scalar()
    return expired.select(
        F.col("n_files").alias("n_expired"), orphans.alias("n_orphans"), files.alias("n_files"), vectors.alias("n_vectors")
    )
