"""Backlog, ids, batches and index cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.neighbours import ENCODER
from catalog.registry import register
from daybook.functions.text import is_non_blank
from daybook.operators import backlog as B
from daybook.operators.embed import Encoder
from daybook.plans import cycle as CY
from daybook.plans.search import SEMANTIC
from daybook.runtime import scratch
from daybook.sources.feeds import stream_table
from daybook.sources.store import ArchiveStore
from daybook.operators.postings import current_stats
from daybook.streaming.index import index_stream

PENDING = "SELECT * FROM docs WHERE path NOT IN (SELECT path FROM docs WHERE doc_id % 3 = 0)"


@register("pending_docs", f"WITH {X.DOCS}, pending AS ({PENDING}) SELECT path, size FROM pending")
def _(spark, sf):
    return B.pending_docs(X.docs(spark, sf), X.indexed(spark, sf)).select("path", "size")


@register("except_paths", f"WITH {X.DOCS} SELECT path FROM docs EXCEPT SELECT path FROM docs WHERE doc_id % 3 = 0")
def _(spark, sf):
    return B.except_paths(X.docs(spark, sf), X.indexed(spark, sf))


@register(
    "capped_pending", f"WITH {X.DOCS}, pending AS ({PENDING}) SELECT path, size FROM pending ORDER BY path LIMIT 100"
)
def _(spark, sf):
    return B.capped_pending(B.pending_docs(X.docs(spark, sf), X.indexed(spark, sf)), 100).select("path", "size")


@register(
    "assign_ids",
    f"""WITH {X.DOCS}, pending AS ({PENDING}) SELECT path,
    (SELECT count(*) FROM docs WHERE doc_id % 3 = 0) + row_number() OVER (ORDER BY path) - 1 AS id FROM pending""",
)
def _(spark, sf):
    done = X.indexed(spark, sf)
    return B.assign_ids(B.pending_docs(X.docs(spark, sf), done), done.count()).select("path", "id")


@register(
    "pack_batches",
    f"""WITH {X.BLANKED}, n AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS id FROM blanked WHERE {X.NOT_BLANK_SQL})
    SELECT path, id, id // 64 AS batch_no FROM n""",
)
def _(spark, sf):
    numbered = B.assign_ids(B.non_blank(X.blanked(spark, sf)))
    return B.pack_batches(numbered).select("path", "id", "batch_no")


@register(
    "changed_docs",
    f"""WITH {X.DOCS} SELECT path FROM docs WHERE doc_id % 3 <> 0 OR doc_id % 2 = 1""",
)
def _(spark, sf):
    seen = F.when(F.col("doc_id") % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") - F.expr("INTERVAL 1 HOUR"))
    stats = X.indexed(spark, sf).select("path", seen.alias("mtime"))
    return B.changed_docs(X.docs(spark, sf), stats).select("path")


# -- cycles into a store -----------------------------------------------------------------------

TODO = f"{X.BLANKED}, todo AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS id FROM blanked WHERE {X.NOT_BLANK_SQL}), n AS (SELECT count(*) AS n FROM todo)"


def _store(spark):
    return ArchiveStore(spark, scratch(spark, "cycle"))


def _size(docs, parts):
    return docs.filter(is_non_blank(F.col("text"))).count() // parts + 1


def _three_cycles(spark, sf):
    store, docs = _store(spark), X.blanked(spark, sf)
    cap = _size(docs, 3)
    for _ in range(3):
        CY.run_cycle(store, docs, ENCODER, cap=cap, backends=(SEMANTIC,))
    return store


@register("append_vectors", f"WITH {TODO} SELECT id, path, {X.DIM} AS dim FROM todo")
def _(spark, sf):
    return CY.load_vector_index(_three_cycles(spark, sf)).select("id", "path", F.size("vec").alias("dim"))


@register(
    "cycle_report",
    f"""WITH {TODO}, c AS (SELECT n, n // 3 + 1 AS cap, unnest([0, 1, 2]) AS cycle FROM n)
    SELECT cycle::BIGINT AS cycle, n - cycle * cap AS discovered, least(cap, n - cycle * cap) AS queued, least(cap, n - cycle * cap) AS added,
    0::BIGINT AS failed_batches, least(n, (cycle + 1) * cap) AS index_size,
    round(100.0 * least(cap, n - cycle * cap) / (n - cycle * cap), 1)::DOUBLE AS progress FROM c""",
)
def _(spark, sf):
    report = CY.cycle_report(_three_cycles(spark, sf))
    cols = ["discovered", "queued", "added", "failed_batches", "index_size", "progress"]
    return report.select(F.col("batch").alias("cycle"), *cols)


@register(
    "load_vector_index",
    f"WITH {X.VECTORS} SELECT id, path, epoch_us(indexed_at) AS indexed_us, len(vec)::INTEGER AS dim FROM vectors",
)
def _(spark, sf):
    store = _store(spark)
    store.replace("vectors", X.vectors(spark, sf))
    return CY.load_vector_index(store).select(
        "id", "path", X.us("indexed_at").alias("indexed_us"), F.size("vec").alias("dim")
    )


def _ticks(step: float = 1.0):
    now = [0.0]

    def clock() -> float:
        now[0] += step
        return now[0]

    return clock


@register("time_budget", f"WITH {TODO} SELECT id, path FROM todo, n WHERE id < 2 * (n // 4 + 1)")
def _(spark, sf):
    """The clock advances one second per look, so the budget ends after the second batch."""
    store, docs = _store(spark), X.blanked(spark, sf)
    CY.run_cycle(
        store, docs, ENCODER, budget_s=1.5, batch_docs=_size(docs, 4), backends=(SEMANTIC,), clock=_ticks()
    )
    return CY.load_vector_index(store).select("id", "path")


def _fails_on(call: int) -> Encoder:
    calls = [0]

    def encode(text):
        calls[0] += 1
        if calls[0] == call:
            raise RuntimeError("encoder lost")
        return ENCODER.encode(text)

    return Encoder(ENCODER.name, ENCODER.dim, encode)


@register(
    "durable_batches",
    f"""WITH {TODO}, b AS (SELECT path, id, id // (n // 4 + 1) AS part FROM todo, n)
    SELECT row_number() OVER (ORDER BY part = 1, id) - 1 AS id, path FROM b""",
)
def _(spark, sf):
    """The second of four batches fails; the others take over its ids and a later cycle mends it."""
    store, docs = _store(spark), X.blanked(spark, sf)
    limits = {"batch_docs": _size(docs, 4), "backends": (SEMANTIC,)}
    CY.run_cycle(store, docs, _fails_on(2), **limits)
    CY.run_cycle(store, docs, ENCODER, **limits)
    return CY.load_vector_index(store).select("id", "path")


@register("force_cycle", f"WITH {TODO} SELECT id, path FROM todo")
def _(spark, sf):
    store, docs = _store(spark), X.blanked(spark, sf)
    CY.force_cycle(store, docs, ENCODER, backends=(SEMANTIC,))
    return CY.load_vector_index(store).select("id", "path")


@register(
    "index_stream",
    f"""WITH {X.BLANKED}, part AS (SELECT path, doc_id // ((SELECT max(doc_id) FROM docs) // 3 + 1) AS chunk FROM blanked WHERE {X.NOT_BLANK_SQL})
    SELECT row_number() OVER (ORDER BY chunk, path) - 1 AS id, path FROM part""",
)
def _(spark, sf):
    store, inbox = _store(spark), scratch(spark, "inbox")
    docs = X.blanked(spark, sf)
    width = docs.agg(F.max("doc_id")).first()[0] // 3 + 1
    for i in range(3):
        docs.filter(F.floor(F.col("doc_id") / width) == i).repartition(2).write.mode("append").parquet(inbox)
    stream = stream_table(spark, inbox, docs.schema, files_per_trigger=2)
    index_stream(stream, store, ENCODER, scratch(spark, "checkpoint")).start().awaitTermination()
    return CY.load_vector_index(store).select("id", "path")


@register(
    "mixed_cycles",
    f"""WITH {X.BLANKED}, part AS (SELECT path, doc_id // ((SELECT max(doc_id) FROM docs) // 4 + 1) AS chunk FROM blanked WHERE {X.NOT_BLANK_SQL})
    SELECT row_number() OVER (ORDER BY chunk, path) - 1 AS id, path, 1::BIGINT AS entries FROM part""",
)
def _(spark, sf):
    """A cycle, a stream, a forced cycle and another stream write one store in turn; every path is indexed once."""
    store = _store(spark)
    docs = X.blanked(spark, sf)
    width = docs.agg(F.max("doc_id")).first()[0] // 4 + 1
    upto = lambda k: docs.filter(F.floor(F.col("doc_id") / width) <= k)
    for k in range(4):
        if k % 2 == 0:
            CY.force_cycle(store, upto(k), ENCODER)
            continue
        inbox = scratch(spark, "inbox")
        docs.filter(F.floor(F.col("doc_id") / width) == k).write.parquet(inbox)
        stream = stream_table(spark, inbox, docs.schema, files_per_trigger=1000)
        index_stream(stream, store, ENCODER, scratch(spark, "checkpoint")).start().awaitTermination()
    entries = current_stats(store).groupBy("path").agg(F.count("*").alias("entries"))
    return CY.load_vector_index(store).select("id", "path").join(entries, "path")


REVISED = f"""{X.DOCS}, final AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN text || ' revised edition' ELSE text END AS text FROM docs),
numbered AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS id FROM docs), {X.embedded_sql('emb', 'final', 'path')}"""


@register(
    "reembed_changed",
    f"""WITH {REVISED} SELECT id, path, (unnest(range({X.DIM})))::INTEGER AS slot,
    unnest(list_transform(vec, lambda x: round(x::DOUBLE, 6) + 0.0)) AS value FROM emb JOIN numbered USING (path)""",
)
def _(spark, sf):
    """After a second cycle every document has one vector under its first id, of its present text; a fifth of the texts changed."""
    store, d = _store(spark), X.docs(spark, sf)
    CY.run_cycle(store, d, ENCODER)
    changed = F.col("doc_id") % 5 == 0
    later = d.withColumn("text", F.when(changed, F.concat("text", F.lit(" revised edition"))).otherwise(F.col("text"))).withColumn(
        "mtime", F.when(changed, F.col("mtime") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("mtime"))
    )
    CY.run_cycle(store, later, ENCODER, reembed=True)
    rows = CY.load_vector_index(store).select("id", "path", F.posexplode("vec").alias("slot", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6) + F.lit(0.0))
