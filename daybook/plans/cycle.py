"""The index cycle: keyword update, then embed pending documents in durable batches."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.display import progress_pct
from daybook.functions.text import is_non_blank
from daybook.operators.backlog import capped_pending, changed_docs, of_their_days, pending_docs, ranked_paths
from daybook.operators.embed import Encoder, embed_texts, index_state
from daybook.operators.postings import current_stats, update_keyword_index
from daybook.plans.search import BACKENDS, KEYWORD, SEMANTIC
from daybook.runtime import broadcast_if_small, durable, small
from daybook.sources.store import ArchiveStore

CYCLE_BATCH = 1_000_000
MAX_BROADCAST = 1_000_000


@dataclass
class CycleReport:
    discovered: int = 0
    queued: int = 0
    added: int = 0
    failed_batches: int = 0
    index_size: int = 0
    elapsed_s: float = 0.0


def load_vector_index(store: ArchiveStore, without_batch: int | None = None) -> DataFrame:
    return store.read("vectors", without_batch)


def append_vectors(store: ArchiveStore, numbered: DataFrame, encoder: Encoder, batch: int) -> None:
    """Embed documents that carry ids and write them as one batch. A retry replaces the batch."""
    store_vectors(store, embed_texts(numbered, encoder), encoder, batch)


def store_vectors(store: ArchiveStore, embedded: DataFrame, encoder: Encoder, batch: int) -> None:
    """Write documents that carry ids and vectors as one batch."""
    rows = embedded.select(
        "id",
        "path",
        "vec",
        F.lit(encoder.dim).alias("dim"),
        F.lit(encoder.name).alias("encoder"),
        F.current_timestamp().alias("indexed_at"),
    )
    store.append("vectors", rows, batch)


def reembed_changed(store: ArchiveStore, docs: DataFrame, changed: DataFrame, encoder: Encoder) -> int:
    """Give indexed documents of `changed` (path) a vector of their present text under the same id; returns how many had one.

    The new vectors are a batch of their own; then the batches that hold the old ones are rewritten without them, and no other. A crash
    in between leaves both, and the next call removes all but the newest. A document that is blank now loses its vector.
    """
    old = load_vector_index(store).join(broadcast_if_small(changed.select("path").distinct(), MAX_BROADCAST), "path", "left_semi")
    old = durable(old.select("id", "path", "batch"))
    touched = [r.batch for r in old.select("batch").distinct().collect()]
    if not touched:
        return 0
    ids = old.groupBy("path").agg(F.min("id").alias("id"))
    texts = of_their_days(docs, ids).filter(F.coalesce(is_non_blank(F.col("text")), F.lit(False)))
    append_vectors(store, texts.join(broadcast_if_small(ids, MAX_BROADCAST), "path"), encoder, store.next_batch("vectors"))
    kept = load_vector_index(store).filter(F.col("batch").isin(touched)).join(old.select("id", "batch"), ["id", "batch"], "left_anti")
    store.rewrite_batches("vectors", touched, kept)
    return ids.count()


@dataclass(frozen=True)
class Work:
    """The pending documents of a cycle: paths only. Texts are never shuffled to find them."""

    paths: DataFrame
    blank: DataFrame
    n_paths: int
    n_blank: int


def pending_work(
    store: ArchiveStore, docs: DataFrame, cap: int = 0, compat: bool = False, without_batch: int | None = None
) -> tuple[Work, int]:
    """What to embed and what to record as skipped, plus the number pending before the cap.

    Blank documents are set aside before the cap, so they cannot block a cycle for ever.
    `compat` caps first and leaves blank documents pending.
    """
    done = load_vector_index(store, without_batch).select("path")
    if not compat:
        done = done.unionByName(store.read("skipped", without_batch).select("path"))
    blank = ~F.coalesce(is_non_blank(F.col("text")), F.lit(False))
    fresh = durable(pending_docs(docs.select("path"), done))
    tested = of_their_days(docs, fresh).select("path", blank.alias("blank"))
    pending = durable(tested.join(broadcast_if_small(fresh, MAX_BROADCAST), "path", "left_semi"))
    n = pending.agg(F.count_if(~F.col("blank")).alias("full"), F.count_if("blank").alias("blank")).first()
    full, empty = pending.filter(~F.col("blank")).select("path"), pending.filter("blank").select("path")
    if compat:
        todo = capped_pending(pending, cap).filter(~F.col("blank")).select("path")
        return Work(todo, empty, todo.count(), 0), n.full + n.blank
    queued = min(cap, n.full) if cap else n.full
    todo = capped_pending(full, cap) if queued < n.full else full
    return Work(todo, empty, queued, n.blank), n.full


def record_skipped(store: ArchiveStore, work: Work, batch: int) -> None:
    if work.n_blank:
        store.append("skipped", work.blank.select("path", F.lit("blank").alias("reason")), batch)


def run_cycle(
    store: ArchiveStore,
    docs: DataFrame,
    encoder: Encoder,
    cap: int = 0,
    budget_s: float = 0,
    batch_docs: int = CYCLE_BATCH,
    backends: tuple[str, ...] = BACKENDS,
    compat: bool = False,
    dry_run: bool = False,
    rejects: DataFrame | None = None,
    reembed: bool = False,
    clock: Callable[[], float] = time.monotonic,
) -> CycleReport:
    """One cycle: index keywords, then embed up to `cap` pending documents.

    Documents are numbered in path order and written in batches of `batch_docs`. The budget is
    checked between batches and never interrupts one. A failed batch goes to `dead_letters`,
    its documents stay pending, and later batches take over its ids. `rejects` (path, reason) are files that could not be read
    as text: they are reported the same way and stay pending. If every batch fails, the cycle is recorded and raises. With `reembed`
    documents that changed since the keyword index saw them get new vectors, before the keyword index forgets that they changed.
    """
    begin = clock()
    report = CycleReport()
    if rejects is not None and not dry_run:
        store.append("dead_letters", rejects.select("path", F.col("reason").alias("error")), store.next_batch("dead_letters"))
    if reembed and SEMANTIC in backends and not dry_run:
        known = current_stats(store)
        changed = changed_docs(docs.select("path", "mtime"), known).join(known, "path", "left_semi")
        reembed_changed(store, docs, changed, encoder)
    if KEYWORD in backends and not dry_run:
        update_keyword_index(store, docs, store.next_batch("doc_stats"))
    if SEMANTIC not in backends:
        report.elapsed_s = clock() - begin
        return report

    work, report.discovered = pending_work(store, docs, cap, compat)
    report.queued = work.n_paths
    if dry_run:
        report.elapsed_s = clock() - begin
        return report
    state = index_state(load_vector_index(store), encoder)
    record_skipped(store, work, store.next_batch("skipped"))
    queue = ranked_paths(work.paths) if report.queued else None
    texts = of_their_days(docs, work.paths) if report.queued else docs
    batch = store.next_batch("vectors")
    started, failure = clock(), None
    for low in range(0, report.queued, batch_docs):
        part = queue.filter((F.col("position") >= low) & (F.col("position") < low + batch_docs))
        first_id = state.next_id + report.added - low
        ids = part.select("path", (F.col("position") + first_id).alias("id"))
        numbered = texts.join(small(ids, batch_docs <= MAX_BROADCAST), "path")
        try:
            append_vectors(store, numbered, encoder, batch)
            report.added += min(batch_docs, report.queued - low)
            batch += 1
        except Exception as e:  # noqa: BLE001 - the next batch must still run
            failure = e
            report.failed_batches += 1
            reason = F.lit(str(e).splitlines()[0]).alias("error")
            store.append("dead_letters", part.select("path", reason), store.next_batch("dead_letters"))
        if budget_s and clock() - started > budget_s:
            break
    report.index_size = state.size + report.added
    report.elapsed_s = clock() - begin
    _record(store, report)
    if failure is not None and report.added == 0 and report.failed_batches > 0:
        # One bad batch is a bad batch; if none gets through, something else is wrong.
        raise RuntimeError(f"all {report.failed_batches} batches of the cycle failed") from failure
    return report


def _record(store: ArchiveStore, report: CycleReport) -> None:
    row = store.spark.range(1).select(
        *[F.lit(v).alias(k) for k, v in vars(report).items()], F.current_timestamp().alias("finished_at")
    )
    store.append("cycles", row, store.next_batch("cycles"))


def cycle_report(store: ArchiveStore) -> DataFrame:
    """All recorded cycles with the share of the discovered documents that was added."""
    return store.read("cycles").withColumn("progress", progress_pct(F.col("added"), F.col("discovered")))


def force_cycle(store: ArchiveStore, docs: DataFrame, encoder: Encoder, **limits) -> CycleReport:
    """Run a cycle now, under the same limits as a scheduled one."""
    return run_cycle(store, docs, encoder, **limits)
