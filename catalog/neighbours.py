"""Vectors, nearest neighbours, semantic and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import register
from catalog.texts import FEEDBACK, REFINED, SEARCH
from daybook.operators import neighbours as N
from daybook.operators.backlog import assign_ids
from daybook.operators import refine as RF
from daybook.operators.embed import default_encoder, embed_texts
from daybook.operators.ranked import refine_from_store
from daybook.plans import search as S
from daybook.runtime import stored

ENCODER = default_encoder(X.DIM)


@register(
    "embed_texts",
    f"""WITH {X.DOCS}, {X.embedded_sql('emb', 'docs', 'path')} SELECT path, (unnest(range({X.DIM})))::INTEGER AS slot,
    unnest(list_transform(vec, lambda x: round(x::DOUBLE, 6) + 0.0)) AS value FROM emb""",
)
def _(spark, sf):
    rows = embed_texts(X.docs(spark, sf), ENCODER).select("path", F.posexplode("vec").alias("slot", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6) + F.lit(0.0))


FIRST_VEC = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@register(
    "knn",
    f"WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1) "
    f"SELECT vec_id AS id, {X.DISTANCE_SQL.format(a='embedding', b='v')} AS distance FROM embeddings, q ORDER BY 2, 1 LIMIT 5",
)
def _(spark, sf):
    v = X.vectors(spark, sf)
    query = v.orderBy("id").limit(1).first().vec
    return N.knn(v, query, 5)


ALL_PAIRS = f"""ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INTEGER AS rank, id, distance FROM
  (SELECT q.vec_id AS query_id, c.vec_id AS id, {X.DISTANCE_SQL.format(a='c.embedding', b='q.embedding')} AS distance
   FROM embeddings q, embeddings c))"""


def _all_queries(vectors):
    return vectors.select(F.col("id").alias("query_id"), "vec")


def _index(spark, sf):
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@register("knn_join", f"WITH {ALL_PAIRS} SELECT * FROM ranked WHERE rank <= 5")
def _(spark, sf):
    v = _index(spark, sf)
    return N.knn_join(v, _all_queries(v), 5)


@register("knn_join_sql", f"WITH {ALL_PAIRS} SELECT * FROM ranked WHERE rank <= 5")
def _(spark, sf):
    v = _index(spark, sf)
    return N.knn_join_sql(v, _all_queries(v), 5)


@register(
    "knn_approx",
    f"""WITH {ALL_PAIRS} SELECT query_id, count(*) AS n_hits, true AS complete_and_near FROM ranked WHERE rank <= 5 GROUP BY query_id""",
)
def _(spark, sf):
    """Hits per query, and whether 95 % of all exact neighbours are among the approximate ones."""
    v = _index(spark, sf)
    hits, exact = N.knn_approx(v, _all_queries(v), 5), N.knn_join(v, _all_queries(v), 5)
    both = exact.select("query_id", "id").join(hits.select("query_id", "id", F.lit(1).alias("found")), ["query_id", "id"], "left")
    share = both.agg((F.avg(F.coalesce("found", F.lit(0))) >= 0.95).alias("complete_and_near"))
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits")).crossJoin(F.broadcast(share))


@register(
    "hits_to_content",
    f"""WITH {X.VECTORS}, {ALL_PAIRS} SELECT query_id, rank, path, text AS content
    FROM (SELECT * FROM ranked WHERE rank <= 5) JOIN vectors USING (id) JOIN docs USING (path)""",
)
def _(spark, sf):
    v = X.vectors(spark, sf)
    hits = S.hits_to_content(N.knn_join(v, _all_queries(v), 5), v, X.docs(spark, sf))
    return hits.select("query_id", "rank", "path", "content")


def _semantic_sql() -> str:
    return f"""{X.embedded_sql('emb', 'docs', 'path')},
numbered AS (SELECT path, vec, row_number() OVER (ORDER BY path) - 1 AS id FROM emb),
{X.embedded_sql('qemb', 'queries', 'query_id')},
near AS (SELECT query_id, path, id, {X.DISTANCE_SQL.format(a='numbered.vec', b='qemb.vec')} AS distance FROM qemb, numbered),
semantic AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INTEGER AS rank, path, distance FROM near
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5)"""


def _doc_vectors(spark, sf):
    """Embedded documents with dense ids in path order. The ids are joined to vectors, which are shorter than texts."""
    embedded = stored(embed_texts(X.docs(spark, sf).select("path", "text"), ENCODER).select("path", "vec"), "embedded")
    return assign_ids(embedded).select("id", "path", "vec")


@register(
    "semantic_search",
    f"""WITH {X.DOCS}, {X.queries_sql()}, {_semantic_sql()}
    SELECT query_id, rank, 'semantic' AS source, path, text AS content, NULL::DOUBLE AS score, distance FROM semantic JOIN docs USING (path)""",
)
def _(spark, sf):
    return S.semantic_search(X.docs(spark, sf), X.archive(spark, sf).read("vectors"), X.queries(spark, sf), ENCODER, 5)


def hybrid(spark, sf, backends=S.BACKENDS, refine=True):
    """Search over the kept archive."""
    store, q = X.archive(spark, sf), X.queries(spark, sf)
    refined = refine_from_store(store, q) if refine else None
    return S.archive_search(store, X.docs(spark, sf), q, ENCODER, refined, backends=backends)


def hybrid_scan(spark, sf):
    """The same with postings and vectors made for this search."""
    d, q = X.docs(spark, sf), X.queries(spark, sf)
    postings, stats = X.text_index(spark, sf)
    return S.hybrid_search(d, postings, stats, _doc_vectors(spark, sf), q, ENCODER, RF.refine_queries(postings, stats, q))


# Required words of the original text, score from original and added words.
HYBRID = f"""{SEARCH}, {FEEDBACK}, {REFINED},
rterms AS (SELECT DISTINCT query_id, unnest({X.WORDS_SQL}) AS term FROM refined),
rscores AS (SELECT query_id, path, round(sum({X.BM25_PART}), 6) AS score FROM matched JOIN rterms USING (query_id)
  JOIN postings USING (term, path) JOIN dfs USING (term) JOIN stats USING (path), corpus GROUP BY ALL),
kw AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path))::INTEGER AS rank, path, score FROM rscores),
{_semantic_sql()}
SELECT query_id, rank, 'keyword' AS source, path, score, NULL::DOUBLE AS distance, 0 AS backend_order, text AS content
FROM kw JOIN docs USING (path) WHERE rank <= 10
UNION ALL SELECT query_id, rank, 'semantic', path, NULL, distance, 1, text FROM semantic JOIN docs USING (path)"""


@register("hybrid_search", HYBRID)
def _(spark, sf):
    return hybrid(spark, sf)


@register("hybrid_search_scan", HYBRID)
def _(spark, sf):
    return hybrid_scan(spark, sf)


@register(
    "hybrid_union",
    f"""WITH {ALL_PAIRS}, k AS (SELECT vec_id AS query_id, 1 AS rank, label::VARCHAR AS path FROM embeddings)
    SELECT query_id, rank, path, NULL::DOUBLE AS distance, 0 AS backend_order FROM k
    UNION ALL SELECT query_id, rank, NULL, distance, 1 FROM ranked WHERE rank <= 5""",
)
def _(spark, sf):
    v = _index(spark, sf)
    keyword = X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), F.col("label").cast("string").alias("path")
    )
    semantic = N.knn_join(v, _all_queries(v), 5).drop("id")
    return S.hybrid_union(keyword, semantic).select("query_id", "rank", "path", "distance", "backend_order")


@register(
    "backend_toggle",
    f"""WITH {X.DOCS}, {X.queries_sql()}, {_semantic_sql()}
    SELECT query_id, rank, 'semantic' AS source, path, distance FROM semantic""",
)
def _(spark, sf):
    hits = hybrid(spark, sf, backends=(S.SEMANTIC,), refine=False)
    return hits.select("query_id", "rank", "source", "path", "distance")
