"""Keyword index, matching, ranking and refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import register
from daybook.functions.text import is_non_blank
from daybook.operators import keyword as KW
from daybook.operators import postings as P
from daybook.operators import ranked as RK
from daybook.operators import refine as RF
from daybook.operators.extract import extract_html
from daybook.runtime import durable, scratch
from daybook.sources.store import ArchiveStore


@register("non_blank", f"WITH {X.BLANKED} SELECT path FROM blanked WHERE {X.NOT_BLANK_SQL}")
def _(spark, sf):
    return X.blanked(spark, sf).filter(is_non_blank(F.col("text"))).select("path")


@register(
    "term_statistics",
    f"WITH {X.TEXT_INDEX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM postings GROUP BY term",
)
def _(spark, sf):
    return P.term_statistics(P.build_postings(X.docs(spark, sf), positions=False))


SEARCH = f"WITH {X.TEXT_INDEX}, {X.queries_sql()}, {X.TERMS_SQL}"


@register(
    "postings_match",
    f"{SEARCH} SELECT term, path, tf FROM postings WHERE term IN (SELECT term FROM terms)",
)
def _(spark, sf):
    postings = P.build_postings(X.docs(spark, sf), positions=False)
    return KW.postings_match(postings, KW.query_terms(X.queries(spark, sf)))


# Hits of each way to match, over all words of every search; shared parts are computed once.
MODES_SQL = {
    "all": f"{X.MATCH_ALL_SQL} SELECT query_id, path FROM matched",
    "any": "anyof AS (SELECT DISTINCT query_id, path FROM terms JOIN postings USING (term)) SELECT query_id, path FROM anyof",
    "phrase": rf"""spaced AS MATERIALIZED (SELECT path, ' ' || array_to_string({X.WORDS_SQL}, ' ') || ' ' AS line FROM docs)
    SELECT query_id, path FROM queries JOIN spaced ON contains(line, ' ' || queries.text || ' ')""",
    "none": rf"""anyof AS (SELECT DISTINCT query_id, path FROM terms JOIN postings USING (term)),
    barred AS (SELECT item_id AS query_id, list_max({X.WORDS_SQL}) AS term FROM benchmark),
    held AS MATERIALIZED (SELECT DISTINCT query_id, path FROM barred JOIN postings USING (term))
    SELECT a.query_id, a.path FROM anyof a LEFT JOIN held h ON h.query_id = a.query_id AND h.path = a.path WHERE h.path IS NULL""",
}
PARTS = SEARCH.replace("postings AS (", "postings AS MATERIALIZED (").replace("terms AS (", "terms AS MATERIALIZED (", 1)


def _match(spark, sf, mode: str):
    """One way to match; positions are kept only where words must follow each other."""
    queries = X.queries(spark, sf)
    postings = P.build_postings(X.docs(spark, sf), positions=mode == "phrase")
    if mode == "none":
        return KW.keyword_match(durable(KW.postings_match(postings, KW.query_terms(queries))), queries, "any", without=X.barred_words(spark, sf))
    return KW.keyword_match(postings, queries, mode)


for _mode, _sql in MODES_SQL.items():
    register(f"keyword_match_{_mode}", f"{PARTS}, {_sql}")(lambda spark, sf, mode=_mode: _match(spark, sf, mode))


def _union_sql() -> str:
    """All four ways in one result."""
    any_sql, none_sql = MODES_SQL["any"], MODES_SQL["none"]
    shared = any_sql[: any_sql.index(" SELECT query_id, path FROM anyof")]
    return f"""{PARTS}, {X.MATCH_ALL_SQL}, {shared},
    {MODES_SQL["phrase"][: MODES_SQL["phrase"].index("SELECT query_id, path")]}, {none_sql[none_sql.index("barred AS") : none_sql.index("SELECT a.query_id")]}
    SELECT 'all' AS mode, query_id, path FROM matched UNION ALL SELECT 'any', query_id, path FROM anyof
    UNION ALL SELECT 'phrase', {MODES_SQL["phrase"].partition("SELECT ")[2].partition("SELECT ")[2]}
    UNION ALL SELECT 'none', {none_sql[none_sql.index("a.query_id") :]}"""


@register("keyword_match", _union_sql())
def _(spark, sf):
    queries = X.queries(spark, sf)
    postings = durable(KW.postings_match(P.build_postings(X.docs(spark, sf)), KW.query_terms(queries)))
    parts = {
        "all": KW.keyword_match(postings, queries, "all"),
        "any": KW.keyword_match(postings, queries, "any"),
        "phrase": KW.keyword_match(postings, queries, "phrase"),
        "none": KW.keyword_match(postings, queries, "any", without=X.barred_words(spark, sf)),
    }
    out = None
    for mode, hits in parts.items():
        part = hits.select(F.lit(mode).alias("mode"), "query_id", "path")
        out = part if out is None else out.unionByName(part)
    return out


RANKED = f"""{X.MATCH_ALL_SQL}, {X.BM25_SQL},
scores AS (SELECT query_id, path, round(sum({X.BM25_PART}), 6) AS score FROM matched JOIN terms USING (query_id)
  JOIN postings USING (term, path) JOIN dfs USING (term) JOIN stats USING (path), corpus GROUP BY ALL),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path))::INTEGER AS rank, path, score FROM scores)"""


RANKED_SQL = f"{SEARCH}, {RANKED} SELECT * FROM ranked WHERE rank <= 10"


@register("keyword_search", RANKED_SQL)
def _(spark, sf):
    return RK.ranked_search(X.archive(spark, sf), X.queries(spark, sf), 10)


@register("keyword_search_scan", RANKED_SQL)
def _(spark, sf):
    """The same over plain postings, built for this search."""
    d = X.docs(spark, sf)
    stats = durable(P.doc_lengths(d))
    hits = KW.keyword_search(P.build_postings(d, positions=False), stats, X.queries(spark, sf), 10)
    return hits.select("query_id", "rank", "path", "score")


FEEDBACK = f"""{RANKED}, top AS (SELECT query_id, path FROM ranked WHERE rank <= 5),
cand AS (SELECT query_id, term, sum(tf / len) AS w FROM top JOIN postings USING (path) JOIN stats USING (path) GROUP BY ALL),
weighted AS (SELECT query_id, term, round(w * ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS weight
  FROM cand JOIN dfs USING (term), corpus WHERE (query_id, term) NOT IN (SELECT (query_id, term) FROM terms)),
extra AS (SELECT query_id, string_agg(term, ' ' ORDER BY weight DESC, term) AS words FROM (SELECT * FROM weighted
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) <= 5) GROUP BY 1)"""
REFINED = "refined AS (SELECT query_id, CASE WHEN words IS NULL THEN text ELSE text || ' ' || words END AS text FROM queries LEFT JOIN extra USING (query_id))"


REFINED_SQL = f"{SEARCH}, {FEEDBACK}, {REFINED} SELECT query_id, text FROM refined"


@register("refine_queries", REFINED_SQL)
def _(spark, sf):
    return RK.refine_from_store(X.archive(spark, sf), X.queries(spark, sf))


@register("refine_queries_scan", REFINED_SQL)
def _(spark, sf):
    """The same over plain postings, built for this search."""
    return RF.refine_queries(*X.text_index(spark, sf), X.queries(spark, sf))


@register(
    "expand_synonyms",
    f"""{SEARCH}, spoken AS (SELECT {X.WORDS_SQL} AS w FROM conversations),
    synonyms AS (SELECT DISTINCT w[i] AS term, w[i + 1] AS synonym FROM (SELECT w, unnest(range(1, len(w))) AS i FROM spoken)),
    extra AS (SELECT query_id, string_agg(DISTINCT synonym, ' ' ORDER BY synonym) AS words FROM terms JOIN synonyms USING (term) GROUP BY 1), {REFINED}
    SELECT query_id, text FROM refined""",
)
def _(spark, sf):
    """Words that follow each other anywhere in a conversation stand in for synonyms."""
    words = X.table(spark, sf, "conversations").select(X.tokens(F.col("text")).alias("w")).filter(F.size("w") > 1)
    pairs = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("term"), F.slice("w", F.lit(2), F.size("w") - 1).alias("synonym"))
    synonyms = words.select(F.inline(pairs).alias("term", "synonym")).distinct()
    return RF.expand_synonyms(X.queries(spark, sf), synonyms)


@register(
    "extract_text",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(
      replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'),
        '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g'),
        '(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
        '(?s)<[^>]*>', '', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
      '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text, NULL::VARCHAR AS error FROM pages""",
)
def _(spark, sf):
    return extract_html(X.texts(spark, sf, "pages")).select("page_id", "text", "error")


# Two rounds: 5 of 6 documents, then a fifth of them changed, a seventh gone, and the rest new.
FINAL = """final AS (SELECT path, CASE WHEN doc_id % 5 = 0 AND doc_id % 6 <> 0 THEN text || ' revised edition' ELSE text END AS text
  FROM docs WHERE doc_id % 7 <> 0)"""
FINAL_POSTINGS = f"""final_words AS (SELECT path, unnest({X.WORDS_SQL}) AS term, generate_subscripts({X.WORDS_SQL}, 1) - 1 AS pos FROM final)
SELECT term, path, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM final_words GROUP BY term, path"""


def _flat(postings):
    return postings.select("term", "path", "tf", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


@register("build_keyword_index", f"WITH {X.DOCS}, final AS (SELECT path, text FROM docs), {FINAL_POSTINGS}")
def _(spark, sf):
    store = ArchiveStore(spark, scratch(spark, "keyword"))
    P.build_keyword_index(store, X.docs(spark, sf))
    return _flat(P.live_postings(store))


@register(
    "update_ranked_index",
    f"""WITH {X.DOCS}, {FINAL}, final_words AS (SELECT path, unnest({X.WORDS_SQL}) AS term FROM final)
    SELECT term, count(DISTINCT path) AS df FROM final_words GROUP BY term""",
)
def _(spark, sf):
    """Document frequencies of the kept index after a second round that changes and removes documents."""
    store = ArchiveStore(spark, scratch(spark, "ranked"))
    d = X.docs(spark, sf)
    RK.build_ranked_index(store, d.filter("doc_id % 6 <> 0"))
    changed = (F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 6 != 0)
    later = (
        d.filter("doc_id % 7 <> 0")
        .withColumn("text", F.when(changed, F.concat("text", F.lit(" revised edition"))).otherwise(F.col("text")))
        .withColumn("mtime", F.when(changed, F.col("mtime") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("mtime")))
    )
    RK.update_ranked_index(store, later, 1)
    return RK.document_frequencies(store, store.read("term_counts").select("term").distinct(), list(range(RK.BUCKETS)))


@register("update_keyword_index", f"WITH {X.DOCS}, {FINAL}, {FINAL_POSTINGS}")
def _(spark, sf):
    store = ArchiveStore(spark, scratch(spark, "keyword"))
    d = X.docs(spark, sf)
    P.build_keyword_index(store, d.filter("doc_id % 6 <> 0"))
    changed = (F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 6 != 0)
    later = (
        d.filter("doc_id % 7 <> 0")
        .withColumn("text", F.when(changed, F.concat("text", F.lit(" revised edition"))).otherwise(F.col("text")))
        .withColumn("mtime", F.when(changed, F.col("mtime") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("mtime")))
    )
    P.update_keyword_index(store, later, 1)
    return _flat(P.live_postings(store))
