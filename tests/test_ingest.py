import pytest
from pyspark.sql import functions as F

from daybook.operators import captures as C
from daybook.operators import states as S
from daybook.operators.embed import default_encoder
from daybook.operators.extract import extract_html, extract_text
from daybook.operators.postings import build_postings, live_postings
from daybook.plans.cycle import load_vector_index
from daybook.sources.feeds import stream_table
from daybook.sources.files import texts_to_write
from daybook.sources.store import ArchiveStore
from daybook.streaming import ingest as I
from daybook.streaming.index import index_stream
from tests.helpers import captures, states, values
from tests.test_streams import arriving, sample


def with_payload(df):
    return df.withColumn("payload", F.concat(F.lit("<p>frame "), F.col("seq").cast("string"), F.lit(" of "), F.col("window_id"), F.lit("</p>")))


def html(frames):
    return extract_html(frames, "payload")


def run(spark, sources, store, checkpoint, extract=html, **options):
    I.start(I.capture_stream(*sources, store, extract, checkpoint, **options), spark).awaitTermination()


@pytest.mark.parametrize("cuts", [[], [50, 51, 160]])
def test_texts_equal_the_batch_chain_and_feed_the_index(spark, folder, cuts):
    caps, signals = sample(11 + len(cuts))
    cap, sig = with_payload(captures(spark, caps)), states(spark, signals)
    store, enc = ArchiveStore(spark, f"{folder}/store"), default_encoder(8)
    sources = arriving(spark, cap, f"{folder}/c", cuts), arriving(spark, sig, f"{folder}/s", cuts)
    run(spark, sources, store, f"{folder}/ck", excluded=["nothing"])
    kept = C.drop_unchanged(C.exclude_titles(C.with_window(S.gate_paused(cap, sig)), ["nothing"]))
    want = texts_to_write(html(kept))
    assert values(store.read("texts"), "path", "text") == values(want, "path", "text")
    assert store.read("dead_letters").count() == 0
    index_stream(I.stored_texts(store, 2), store, enc, f"{folder}/ck-index").start().awaitTermination()
    assert values(load_vector_index(store), "path") == values(want, "path")
    assert values(live_postings(store), "term", "path") == values(build_postings(want), "term", "path")


def test_state_goes_on_after_a_restart(spark, folder):
    """Flags and hashes of the first run decide about captures of the second one; one query holds both."""
    sig = states(spark, [("a", 5, 1, "lock", True), ("a", 30, 2, "lock", False)])
    cap = with_payload(captures(spark, [("a", 1, 1, "x"), ("a", 10, 2, "z"), ("a", 40, 3, "x"), ("a", 41, 4, "y"), ("b", 42, 5, "y")]))
    store = ArchiveStore(spark, f"{folder}/store")
    for low, high in ((0, 20), (20, 100)):
        sources = []
        for df, name in ((cap, "c"), (sig, "s")):
            begin = 1704067200
            part = df.filter((F.unix_seconds("ts") >= begin + low) & (F.unix_seconds("ts") < begin + high))
            part.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
            sources.append(stream_table(spark, f"{folder}/{name}", df.schema))
        run(spark, sources, store, f"{folder}/ck")
    # Capture 2 is locked out; capture 3 equals the last kept frame of its window.
    assert values(store.read("texts"), "text") == ["frame 1 of a", "frame 4 of a", "frame 5 of b"]


def test_a_replayed_micro_batch_adds_no_row(spark, folder, monkeypatch):
    caps, signals = sample(21)
    cap, sig = with_payload(captures(spark, caps)), states(spark, signals)
    store = ArchiveStore(spark, f"{folder}/store")
    sources = lambda: (stream_table(spark, f"{folder}/c", cap.schema, 1), stream_table(spark, f"{folder}/s", sig.schema, 1))
    arriving(spark, cap, f"{folder}/c", [60]), arriving(spark, sig, f"{folder}/s", [60])
    real, calls = I.write_batch, []

    def crash(*args):
        real(*args)
        calls.append(args[-1])
        if len(calls) == 1:
            raise RuntimeError("power cut")

    monkeypatch.setattr(I, "write_batch", crash)
    with pytest.raises(Exception, match="power cut"):
        run(spark, sources(), store, f"{folder}/ck")
    first = values(store.read("texts"), "path", "text", "batch")
    run(spark, sources(), store, f"{folder}/ck")
    assert calls[0] == calls[1]
    again = [r for r in values(store.read("texts"), "path", "text", "batch") if r[2] == calls[0]]
    assert again == first and first
    kept = texts_to_write(html(C.drop_unchanged(S.gate_paused(cap, sig))))
    assert values(store.read("texts"), "path") == values(kept, "path")


def test_failed_extractions_and_late_captures_are_reported(spark, folder):
    def shout(payload):
        if "7" in payload:
            raise ValueError("unreadable")
        return payload.upper()

    cap = with_payload(captures(spark, [("a", 10, 5, "x"), ("a", 11, 7, "y"), ("a", 12, 8, "z"), ("a", 3, 9, "w"), ("", 13, 10, "q")]))
    sig = states(spark, [("other", 1, 1, "lock", True)])
    sig.coalesce(1).write.parquet(f"{folder}/s")
    order = [F.col("seq") < 9, F.col("seq") >= 9]
    for part in order:
        cap.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/c")
    store = ArchiveStore(spark, f"{folder}/store")
    sources = stream_table(spark, f"{folder}/c", cap.schema, 1), stream_table(spark, f"{folder}/s", sig.schema, 1)
    run(spark, sources, store, f"{folder}/ck", lambda d: extract_text(d, "payload", shout))
    assert values(store.read("texts"), "text") == ["<P>FRAME 5 OF A</P>", "<P>FRAME 8 OF A</P>"]
    begin = 1704067200
    assert values(store.read("dead_letters"), "path", "error") == [(f"a_{begin + 3}.txt", "late"), (f"a_{begin + 11}.txt", "ValueError: unreadable")]


def test_idle_state_expires(spark, folder):
    """With a time to live of zero days nothing is remembered from one run to the next, so an equal frame is kept again."""
    sig = states(spark, [("other", 1, 1, "lock", True)])
    sig.coalesce(1).write.parquet(f"{folder}/s")
    cap = with_payload(captures(spark, [("a", 10, 1, "x"), ("a", 11, 2, "x")]))
    for idle, want in ((90, 1), (1e-9, 2)):
        store, path = ArchiveStore(spark, f"{folder}/store{want}"), f"{folder}/c{want}"
        for seq in (1, 2):
            cap.filter(F.col("seq") == seq).coalesce(1).write.mode("append").parquet(path)
            sources = stream_table(spark, path, cap.schema, 1), stream_table(spark, f"{folder}/s", sig.schema, 1)
            run(spark, sources, store, f"{folder}/ck{want}", idle_days=idle)
        assert store.read("texts").count() == want
