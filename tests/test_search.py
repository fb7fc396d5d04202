import math
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from daybook.functions.vectors import batch_encoder
from daybook.operators import keyword as KW
from daybook.operators import neighbours as N
from daybook.operators import postings as P
from daybook.operators import refine as RF
from daybook.operators.embed import Encoder, default_encoder, embed_texts
from daybook.operators.extract import extract_html, extract_text
from daybook.plans import search as S
from daybook.runtime import setting
from daybook.sources.store import ArchiveStore
from tests.helpers import docs, plan, values

TEXTS = [
    ("d1", "the quick brown fox"),
    ("d2", "The brown quick dog. Quick!"),
    ("d3", "nothing to see"),
    ("d4", "quick brown bread and the quick brown fox again"),
    ("d5", ""),
]


@pytest.fixture(scope="module")
def index(spark):
    d = docs(spark, TEXTS)
    return d, P.build_postings(d).cache(), P.doc_lengths(d).cache()


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")


def test_postings(spark, index):
    _, postings, stats = index
    assert values(postings.filter("term = 'quick'"), "path", "tf", F.array_join(F.col("positions").cast("array<string>"), " ")) == [
        ("d1", 1, "1"), ("d2", 2, "2 4"), ("d4", 2, "0 5"),
    ]
    assert values(stats, "path", "len") == [("d1", 4), ("d2", 5), ("d3", 3), ("d4", 9), ("d5", 0)]
    assert ("quick", 3, 5) in values(P.term_statistics(postings), "term", "df", "total_tf")


@pytest.mark.parametrize(
    "mode, text, want",
    [
        ("all", "quick brown", ["d1", "d2", "d4"]),
        ("all", "quick", ["d1", "d2", "d4"]),
        ("all", "quick missing", []),
        ("all", "quick QUICK fox", ["d1", "d4"]),
        ("any", "fox dog", ["d1", "d2", "d4"]),
        ("phrase", "quick brown", ["d1", "d4"]),
        ("phrase", "brown quick", ["d2"]),
        ("phrase", "the quick brown fox", ["d1", "d4"]),
        ("phrase", "quick brown quick", []),
        ("all", "", []),
    ],
)
def test_match(spark, index, mode, text, want):
    assert values(KW.keyword_match(index[1], queries(spark, text), mode), "path") == want


def test_match_without(spark, index):
    hits = KW.keyword_match(index[1], queries(spark, "quick"), "all", without=queries(spark, "dog bread"))
    assert values(hits, "path") == ["d1"]


def test_match_any_puts_a_document_together_in_one_task(spark, index):
    """Hits of each term are not shuffled: no exchange deals by query and document."""
    some = spark.createDataFrame([(1, "quick fox"), (2, "dog"), (3, "missing"), (None, "fox")], "query_id long, text string")
    anyof = KW.keyword_match(index[1], some, "any")
    assert sorted(map(tuple, anyof.collect()), key=repr) == sorted(brute_any(index[1], some), key=repr)
    barred = spark.createDataFrame([(1, "dog"), (2, "quick"), (2, "dog"), (None, "fox")], "query_id long, text string")
    none = KW.keyword_match(index[1], some, "any", without=barred)
    out = {(q, p) for q, p in brute_any(index[1], barred) if q is not None}
    assert sorted(map(tuple, none.collect()), key=repr) == sorted(set(brute_any(index[1], some)) - out, key=repr)
    for hits in (anyof, none):
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, path", plan(hits))


def brute_any(postings, asked):
    rows = [(r.term, r.path) for r in postings.collect()]
    return {(q.query_id, p) for q in asked.collect() for t, p in rows if t in KW_tokens(q.text)}


def brute_bm25(term_lists, texts):
    words = {p: KW_tokens(t) for p, t in texts}
    avg = sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in {t for ts in term_lists for t in ts}}
    out = {}
    for q, terms in enumerate(term_lists):
        for p, w in words.items():
            score = 0.0
            for t in terms:
                tf = w.count(t)
                if tf:
                    idf = math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5))
                    score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
            out[q, p] = round(score, 6)
    return out


def KW_tokens(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def test_bm25_rank_and_ties(spark):
    texts = TEXTS + [("d0", TEXTS[0][1])]
    d = docs(spark, texts)
    hits = KW.keyword_search(P.build_postings(d), P.doc_lengths(d), queries(spark, "quick brown", "fox"), 3)
    score = brute_bm25([["quick", "brown"], ["fox"]], texts)
    got = values(hits, "query_id", "rank", "path", "score")
    assert [(q, p, s) for q, _, p, s in got] == [(q, p, score[q, p]) for q, _, p, _ in got]
    assert [r[1] for r in got] == [1, 2, 3, 1, 2, 3]
    assert [p for q, _, p, _ in got if q == 1] == ["d0", "d1", "d4"]


def test_optional_words_rank_but_are_not_required(spark, index):
    _, postings, stats = index
    q, wide = queries(spark, "quick"), queries(spark, "quick fox dog")
    assert {r.path for r in KW.keyword_search(postings, stats, q, 9, optional=wide).collect()} == {"d1", "d2", "d4"}
    assert KW.keyword_search(postings, stats, wide, 9).count() == 0
    assert KW.keyword_search(postings, stats, wide, 9, mode="any").count() == 3


def test_refiners(spark, index):
    _, postings, stats = index
    q = queries(spark, "quick", "zzz")

    def refine(text):
        if text == "zzz":
            raise RuntimeError("model away")
        return text + " fast "

    assert values(RF.refine_with(q, refine), "text") == ["quick fast", "zzz"]
    assert RF.refine_with(q, None) is q
    pairs = spark.createDataFrame([("quick", "fast"), ("quick", "brisk")], "term string, synonym string")
    assert values(RF.expand_synonyms(q, pairs), "text") == ["quick brisk fast", "zzz"]
    fed = dict(values(RF.refine_queries(postings, stats, q, n_docs=2, n_terms=2), "query_id", "text"))
    assert fed[1] == "zzz" and fed[0].startswith("quick ") and len(fed[0].split()) == 3


# -- vectors -----------------------------------------------------------------------------------


def frame(spark, matrix, key="id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} long, vec array<float>")


def brute_knn(data, wanted, k):
    out = []
    for q, v in enumerate(np.float32(wanted).astype(float)):
        d = np.round(((np.float32(data).astype(float) - v) ** 2).sum(1), 6)
        out += [(q, r + 1, int(i), float(d[i])) for r, i in enumerate(np.lexsort((np.arange(len(d)), d))[:k])]
    return out


@pytest.mark.parametrize("n, k, block", [(300, 5, 2048), (300, 7, 4), (3, 5, 2048)])
def test_knn_join_is_exact(spark, n, k, block):
    rng = np.random.default_rng(n + k)
    data = rng.normal(size=(n, 8))
    data[n // 2 :] = data[0]  # a third and more of the rows are copies
    wanted = np.vstack([rng.normal(size=(9, 8)), data[:1]])
    vectors, q = frame(spark, data).repartition(3), frame(spark, wanted, "query_id")
    want = brute_knn(data, wanted, k)
    cols = ("query_id", "rank", "id", "distance")
    assert values(N.knn_join(vectors, q, k, block), *cols) == want
    assert values(N.knn_join_sql(vectors, q, k), *cols) == want
    first = N.knn(vectors, [float(x) for x in np.float32(wanted[0])], k).collect()
    assert [(r.id, r.distance) for r in first] == [(i, d) for q_, _, i, d in want if q_ == 0]


def test_knn_empty_and_wrong_dimension(spark):
    empty = spark.createDataFrame([], "id long, vec array<float>")
    q = frame(spark, [[1, 2]], "query_id")
    assert N.knn_join(empty, q).count() == 0
    assert N.knn_join(frame(spark, [[1, 2]]), q.limit(0)).count() == 0
    mixed = frame(spark, [[1, 2]]).unionByName(frame(spark, [[1, 2, 3]]).withColumn("id", F.lit(9).cast("long")))
    assert values(N.knn_join(mixed, q), "id") == [0]


def test_knn_approx_is_complete_and_near(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    v = frame(spark, data)
    q = v.select(F.col("id").alias("query_id"), "vec")
    exact = set(values(N.knn_join(v, q, 5), "query_id", "id"))
    for block in (2048, 16):  # small blocks cut cells into several lists
        near = N.knn_approx(v, q, 5, block=block)
        assert near.count() == 2000
        assert len(exact & set(values(near, "query_id", "id"))) / len(exact) >= 0.95


def test_knn_approx_visits_few_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 10
    data = np.concatenate([c + rng.normal(size=(40, 16)) * 0.1 for c in centres])
    cells = N.fit_cells(frame(spark, data), 16, 5, 0.98)
    assert cells.probes <= len(cells.centres) // 4


@pytest.mark.parametrize("join", [N.knn_join, N.knn_join_sql, N.knn_approx])
def test_queries_without_a_comparable_vector_have_no_hits(spark, join):
    v = frame(spark, [[1, 2], [3, 4], [5, 6]])
    schema = "query_id long, vec array<float>"
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, 2.0, 3.0]), (4, [])], schema)
    assert values(join(v, q, 2), "query_id", "rank", "id") == [(1, 1, 0), (1, 2, 1)]
    assert join(v, q.limit(0), 2).count() == 0


@pytest.mark.parametrize("join", [N.knn_join, N.knn_join_sql])
def test_queries_beyond_one_block_keep_repeated_ids(spark, join):
    rng = np.random.default_rng(9)
    data, wanted = rng.normal(size=(70, 8)), rng.normal(size=(9, 8))
    ids = [0, 1, 2, 2, 2, 2, 3, 4, 4]
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, wanted)], "query_id long, vec array<float>")
    want = []
    for i in sorted(set(ids)):
        near = sorted((d, n) for _, _, n, d in brute_knn(data, [w for j, w in zip(ids, wanted) if j == i], 4))[:4]
        want += [(i, r + 1, n, d) for r, (d, n) in enumerate(near)]
    assert values(join(frame(spark, data).repartition(3), q, 4, 3), "query_id", "rank", "id", "distance") == want


def test_knn_join_sql_ranks_few_of_all_pairs(spark):
    rng = np.random.default_rng(10)
    data = rng.normal(size=(600, 8))
    v = frame(spark, data)
    near = N._near_sql(v, v.select(F.col("id").alias("query_id"), F.col("vec").alias("_q")), 3, 8, 600, 600, 256)
    assert 1800 <= near.count() < 600 * 600 / 10


def test_knn_plan_cuts_before_the_shuffle(spark):
    v = frame(spark, np.eye(4))
    text = plan(N.knn_join(v, v.select(F.col("id").alias("query_id"), "vec")))
    assert text.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in text
    assert "TakeOrderedAndProject" in plan(N.knn(v, [0.0, 0.0, 0.0, 0.0]))


def test_encoder(spark):
    enc = default_encoder(32)
    rows = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", None), ("d", "Y X x")], "path string, text string")
    got = {r.path: np.array(r.vec) for r in embed_texts(rows, enc).collect()}
    assert all(len(v) == 32 for v in got.values())
    assert np.isclose(np.linalg.norm(got["a"]), 1) and not got["b"].any() and not got["c"].any()
    assert np.allclose(got["a"], got["d"])


def test_plugged_in_encoder_sees_bounded_batches(spark):
    def model(texts):
        assert len(texts) <= 4
        return np.array([[len(t), 1.0] for t in texts])

    enc = Encoder("len", 2, batch_encoder(model, rows=4))
    rows = spark.range(30).select(F.repeat(F.lit("a"), F.col("id").cast("int")).alias("text"))
    assert values(embed_texts(rows, enc).select(F.col("vec")[0].cast("int").alias("n")), "n") == list(range(30))


def test_hybrid_order_backends_and_missing_documents(spark, index):
    d, postings, stats = index
    enc = default_encoder(32)
    vectors = embed_texts(d.filter("text <> ''"), enc).select(
        F.row_number().over(Window.orderBy("path")).cast("long").alias("id"), "path", "vec"
    )
    q = queries(spark, "quick brown")
    present = d.filter("path <> 'd1'")
    hits = S.hybrid_search(present, postings, stats, vectors, q, enc, k_keyword=5, k_semantic=2)
    rows = sorted(hits.collect(), key=lambda r: (r.backend_order, r.rank))
    assert [r.source for r in rows[:2]] == ["keyword"] * 2 and all(r.distance is None for r in rows[:2])
    assert {r.source for r in rows[2:]} == {"semantic"} and all(r.content for r in rows)
    assert "d1" not in {r.path for r in rows}
    only = S.hybrid_search(d, postings, stats, vectors, q, enc, backends=(S.SEMANTIC,))
    assert {r.source for r in only.collect()} == {"semantic"}
    with pytest.raises(ValueError):
        S.hybrid_search(d, postings, stats, vectors, q, enc, backends=())


def test_extractors(spark):
    pages = spark.createDataFrame([(1, "<p>hi</p>"), (2, None)], "id long, html string")
    assert [tuple(r) for r in extract_html(pages).orderBy("id").collect()] == [(1, "hi", None), (2, None, "no payload")]
    frames = spark.createDataFrame([(1, b"ok"), (2, b"\xff")], "id long, frame binary")
    got = extract_text(frames, "frame", lambda b: bytes(b).decode()).orderBy("id").collect()
    assert got[0].text == "ok" and got[0].error is None
    assert got[1].text is None and got[1].error.startswith("UnicodeDecodeError")


# -- stored index ------------------------------------------------------------------------------


def test_index_updates_equal_one_shot(spark, folder):
    store = ArchiveStore(spark, folder)
    P.build_keyword_index(store, docs(spark, [("a", "one two"), ("b", "two three"), ("c", "gone")]))
    final = docs(spark, [("a", "one two"), ("b", "changed text", 50), ("d", "new two")])
    assert values(P.update_keyword_index(store, final, 1), "path") == ["b", "d"]
    want = values(P.build_postings(final), "term", "path", "tf")
    assert values(P.live_postings(store), "term", "path", "tf") == want
    # A retry of the batch changes nothing, and a quiet cycle indexes nothing.
    P.update_keyword_index(store, final, 1)
    assert values(P.live_postings(store), "term", "path", "tf") == want
    assert P.update_keyword_index(store, final, 2).count() == 0
    terms = spark.createDataFrame([("two",)], "term string")
    assert values(P.live_postings(store, terms), "path") == ["a", "d"]
    assert values(P.current_stats(store), "path", "len") == [("a", 2), ("b", 2), ("d", 2)]
    # A document that comes back is indexed again.
    again = final.unionByName(docs(spark, [("c", "gone", 90)]))
    P.update_keyword_index(store, again, 3)
    assert values(P.live_postings(store), "term", "path", "tf") == values(P.build_postings(again), "term", "path", "tf")


def test_postings_counted_by_document_are_the_grouped_ones(spark):
    rows = [("d1", "Red fox, red den é"), ("d2", "den den den"), ("d2", "a den"), (None, "fox"), (None, "fox red"), ("d3", None), ("d4", " ")]
    some, once = spark.createDataFrame(rows, "path string, text string"), spark.createDataFrame(rows[:2], "path string, text string")
    for positions in (True, False):
        names = ["term", "path", "tf", "positions"][: 3 + positions]
        for d in (some, once, some.limit(0)):
            made = P.build_postings(d, positions=positions, whole=True)
            assert made.columns == names and made.dtypes == P.build_postings(d, positions=positions).dtypes
            found, want = made.collect(), P.build_postings(d, positions=positions).collect()
            assert sorted(found, key=repr) == sorted(want, key=repr)
        # Nothing is shuffled where every path stands once.
        assert "Exchange" not in plan(P.build_postings(once, positions=positions, whole=True))


def test_postings_of_sliced_batches(spark, monkeypatch):
    import pyarrow as pa

    from daybook.functions import vectors as V

    monkeypatch.setattr(V, "COUNTED_WORDS", 4)
    words = [["b", "a", "b"], None, [], ["a", "c", "a", "a", "b"], ["c"]]
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(5)]), pa.array(words, pa.list_(pa.string()))], ["path", "words"])
    got = sorted((r["path"], r["term"], r["tf"], r["positions"]) for b in P._posted(iter([batch]), True) for r in b.to_pylist())
    assert got == [("d0", "a", 1, [1]), ("d0", "b", 2, [0, 2]), ("d3", "a", 3, [0, 2, 3]), ("d3", "b", 1, [4]), ("d3", "c", 1, [1]), ("d4", "c", 1, [0])]


def test_the_pairs_of_the_sql_join_are_compiled(spark):
    """A join of two rows with 64 entries each is beyond Spark's limit of columns unless the limit is raised; its rows then pass an interpreter."""
    rng = np.random.default_rng(5)
    made = [(i, [float(x) for x in rng.standard_normal(64)]) for i in range(300)]
    v = spark.createDataFrame(made, "id long, vec array<float>")
    asked = v.select(F.col("id").alias("query_id"), F.col("vec").alias("_q"))
    with setting(spark, "spark.sql.adaptive.enabled", False), setting(spark, "spark.sql.codegen.maxFields", 2 * N.SQL_DIMS + 16):
        near = N._near_sql(v, asked, 5, 64, 300, 300, 64)
        assert "* ShuffledHashJoin" in plan(near)
    limit = spark.conf.get("spark.sql.codegen.maxFields")
    want = values(N.knn_join(v, v.select(F.col("id").alias("query_id"), "vec"), 5), "query_id", "rank", "id", "distance")
    assert values(N.knn_join_sql(v, v.select(F.col("id").alias("query_id"), "vec"), 5, 64), "query_id", "rank", "id", "distance") == want
    assert spark.conf.get("spark.sql.codegen.maxFields") == limit
