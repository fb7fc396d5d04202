from daybook.operators.embed import default_encoder, embed_texts
from daybook.plans import cycle as CY
from daybook.sources.store import ArchiveStore
from tests.helpers import docs, values


def vectors(store):
    return {r.path: (r.id, [round(x, 6) for x in r.vec]) for r in CY.load_vector_index(store).collect()}


def expected(spark, rows, enc):
    return {r.path: [round(x, 6) for x in r.vec] for r in embed_texts(docs(spark, rows), enc).collect()}


def test_changed_documents_get_one_new_vector_each(spark, folder, monkeypatch):
    store, enc = ArchiveStore(spark, f"{folder}/store"), default_encoder(8)
    first = [(f"d{i}", f"text number {i}") for i in range(8)]
    CY.run_cycle(store, docs(spark, first[:5]), enc)
    CY.run_cycle(store, docs(spark, first), enc)
    ids = {p: i for p, (i, _) in vectors(store).items()}
    later = [(p, f"{t} revised", 50) if p in ("d1", "d6") else (p, " ", 50) if p == "d3" else (p, t, 0) for p, t in first] + [("new", "fresh text", 60)]
    # A crash between the new batch and the removal of the old vectors leaves both; the next cycle mends it.
    real = ArchiveStore.rewrite_batches

    def crash(*args):
        raise RuntimeError("power cut")

    monkeypatch.setattr(ArchiveStore, "rewrite_batches", crash)
    try:
        CY.run_cycle(store, docs(spark, later), enc, reembed=True)
        raise AssertionError("no crash")
    except RuntimeError:
        pass
    assert len(values(CY.load_vector_index(store), "path")) == 10
    monkeypatch.setattr(ArchiveStore, "rewrite_batches", real)
    CY.run_cycle(store, docs(spark, later), enc, reembed=True)
    got, want = vectors(store), expected(spark, later, enc)
    assert values(CY.load_vector_index(store), "path") == sorted(p for p, *_ in later if p != "d3")
    assert {p: v for p, (_, v) in got.items()} == {p: v for p, v in want.items() if p != "d3"}
    assert {p: i for p, (i, _) in got.items() if p != "new"} == {p: i for p, i in ids.items() if p != "d3"}
    # Nothing changed since: no batch is written.
    before = store.next_batch("vectors")
    CY.run_cycle(store, docs(spark, later), enc, reembed=True)
    assert store.next_batch("vectors") == before


def test_new_documents_are_not_taken_for_changed_ones(spark, folder):
    store, enc = ArchiveStore(spark, f"{folder}/store"), default_encoder(8)
    rows = [("a", "one"), ("b", "two")]
    CY.run_cycle(store, docs(spark, rows), enc, backends=("semantic",))
    before = vectors(store)
    CY.run_cycle(store, docs(spark, rows), enc, reembed=True)
    assert vectors(store) == before and store.next_batch("vectors") == 1
