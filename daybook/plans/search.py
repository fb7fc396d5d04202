"""Search over the archive: semantic, keyword with content, and both together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators.embed import Encoder, embed_texts
from daybook.operators.keyword import keyword_search
from daybook.operators.neighbours import knn_join
from daybook.operators.ranked import ranked_search
from daybook.runtime import fits, small
from daybook.schemas import HITS
from daybook.sources.store import ArchiveStore

KEYWORD, SEMANTIC = "keyword", "semantic"
BACKENDS = (KEYWORD, SEMANTIC)
MAX_HITS = 1_000_000


def _hits(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in HITS]
    )


def with_content(hits: DataFrame, docs: DataFrame, bounded: bool = False) -> DataFrame:
    """Fetch the text of each hit; missing documents drop out.

    `bounded` says that the caller has checked the number of hits, so that they may be
    broadcast. Documents are never the broadcast side.
    """
    return docs.select("path", F.col("text").alias("content")).join(small(hits, bounded), "path")


def hits_to_content(neighbours: DataFrame, vectors: DataFrame, docs: DataFrame, bounded: bool = False) -> DataFrame:
    """Neighbour ids to paths to document texts."""
    paths = vectors.select("id", "path").join(small(neighbours, bounded), "id")
    return with_content(paths, docs, bounded)


def keyword_hits(
    docs: DataFrame, postings: DataFrame, stats: DataFrame, queries: DataFrame,
    k: int = 10, mode: str = "all", optional: DataFrame | None = None,
) -> DataFrame:
    ranked = keyword_search(postings, stats, queries, k, mode, optional)
    bounded = fits(queries, MAX_HITS // k)
    return _hits(with_content(ranked, docs, bounded).withColumn("source", F.lit(KEYWORD)))


def semantic_search(
    docs: DataFrame, vectors: DataFrame, queries: DataFrame, encoder: Encoder, k: int = 5
) -> DataFrame:
    """Embed the queries, find the k nearest documents of each, fetch their texts."""
    embedded = embed_texts(queries, encoder).select("query_id", "vec")
    found = hits_to_content(knn_join(vectors, embedded, k), vectors, docs, fits(queries, MAX_HITS // k))
    return _hits(found.withColumn("source", F.lit(SEMANTIC)))


def hybrid_union(keyword: DataFrame | None, semantic: DataFrame | None) -> DataFrame:
    """Keyword hits, then semantic hits, neither merged nor scored again.

    `backend_order` and `rank` carry the list order. A disabled backend is passed as None.
    """
    parts = [
        df.withColumn("backend_order", F.lit(i)) for i, df in enumerate((keyword, semantic)) if df is not None
    ]
    if not parts:
        raise ValueError("no backend enabled")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def hybrid_search(
    docs: DataFrame,
    postings: DataFrame,
    stats: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    encoder: Encoder,
    refined: DataFrame | None = None,
    k_keyword: int = 10,
    k_semantic: int = 5,
    expansion_required: bool = False,
    backends: tuple[str, ...] = BACKENDS,
) -> DataFrame:
    """Keyword search with the refined text, semantic search with the original text.

    By default the original words are required and the words a refiner adds only raise the
    score; `expansion_required` demands all words of the refined text.
    """
    keyword = semantic = None
    if KEYWORD in backends:
        refined = queries if refined is None else refined
        required, optional = (refined, None) if expansion_required else (queries, refined)
        keyword = keyword_hits(docs, postings, stats, required, k_keyword, "all", optional)
    if SEMANTIC in backends:
        semantic = semantic_search(docs, vectors, queries, encoder, k_semantic)
    return hybrid_union(keyword, semantic)


def archive_search(
    store: ArchiveStore,
    docs: DataFrame,
    queries: DataFrame,
    encoder: Encoder,
    refined: DataFrame | None = None,
    k_keyword: int = 10,
    k_semantic: int = 5,
    expansion_required: bool = False,
    backends: tuple[str, ...] = BACKENDS,
) -> DataFrame:
    """`hybrid_search` over what the store keeps: posting blocks and vectors. Nothing is indexed or embedded but the queries."""
    keyword = semantic = None
    if KEYWORD in backends:
        refined = queries if refined is None else refined
        required, optional = (refined, None) if expansion_required else (queries, refined)
        hits = ranked_search(store, required, k_keyword, optional)
        found = with_content(hits, docs, fits(queries, MAX_HITS // k_keyword))
        keyword = _hits(found.withColumn("source", F.lit(KEYWORD)))
    if SEMANTIC in backends:
        semantic = semantic_search(docs, store.read("vectors"), queries, encoder, k_semantic)
    return hybrid_union(keyword, semantic)
