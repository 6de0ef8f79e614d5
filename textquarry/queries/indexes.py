"""Queries of stored indexes: segments of postings, boolean search, vectors by cell, dictionary hits, order statistics, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import store
from ..functions import text as T
from ..operators import boolean_search, dictionary, order
from ..operators import retrieval as S
from ..operators.segments import Index
from ..operators.vector_index import VectorIndex
from .common import sql_tokens, table
from .ranking import _bm25_sql, _dense_sql, asked

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


# --- segments of postings


@query("segment_topk", f"WITH {_bm25_sql()} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM br WHERE rank <= 30")
def _(spark, d):
    index = Index(spark, store.folder(spark)).append(table(spark, d, "documents"), positions=False)
    return index.top(S.query_terms(asked(spark)), 30).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _upkept(spark, d) -> Index:
    """documents in three appends by language, less one source."""
    docs = table(spark, d, "documents")
    index = Index(spark, store.folder(spark))
    for part in ("lang = 'en'", "lang IN ('de', 'fr')", "coalesce(lang NOT IN ('en', 'de', 'fr'), TRUE)"):
        index.append(docs.where(part), ("lang", "source"), positions=False)
    return index.delete(docs.where("source = 'src7'"))


_LEFT = "source IS DISTINCT FROM 'src7'"


@query("segment_upkeep", f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents WHERE {_LEFT}), f AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL) GROUP BY term)
    SELECT term, df, tf, n, round(avgdl, 6) AS avgdl FROM f CROSS JOIN (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t)""")
def _(spark, d):
    index = _upkept(spark, d)
    tf = index.postings().groupBy("term").agg(F.sum("tf").alias("tf"))
    return index.frequencies().join(tf, "term", "full").withColumns({"n": F.lit(index.n).cast("long"), "avgdl": F.round(F.lit(index.average), 6)})


@query("segment_topk_after_upkeep", f"WITH {_bm25_sql(_LEFT)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM br WHERE rank <= 30")
def _(spark, d):
    return _upkept(spark, d).top(S.query_terms(asked(spark)), 30).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("segment_topk_merged", f"WITH {_bm25_sql(_LEFT)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM br WHERE rank <= 30")
def _(spark, d):
    return _upkept(spark, d).merge().top(S.query_terms(asked(spark)), 30).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


# --- boolean search

#: Expressions and the same as conditions on the tokens w, their text t (tokens between blanks), lang and source.
ASKED_FOR = {
    1: ("queen | enou", "list_has_any(w, ['queen', 'enou'])"),
    2: ('the -idiot "of the" lang:en', "list_contains(w, 'the') AND NOT list_contains(w, 'idiot') AND contains(t, ' of the ') AND lang = 'en'"),
    3: ("thing | tion qu*", "list_has_any(w, ['thing', 'tion']) AND len(list_filter(w, lambda x: starts_with(x, 'qu'))) > 0"),
    4: ("-the", "NOT list_contains(w, 'the')"),
    5: ('[src7] ("the thing" OR (queen -"of the"))', "source = 'src7' AND (contains(t, ' the thing ') OR (list_contains(w, 'queen') AND NOT contains(t, ' of the ')))"),
    6: ("nothinglikethis | NOT e*", "list_contains(w, 'nothinglikethis') OR len(list_filter(w, lambda x: starts_with(x, 'e'))) = 0"),
}


@query("boolean_search", f"WITH d AS (SELECT doc_id, lang, source, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM (SELECT *, {sql_tokens('text')} AS w FROM documents)) " + " UNION ALL ".join(f"SELECT {q} AS query_id, doc_id FROM d WHERE coalesce({x}, FALSE)" for q, (_, x) in ASKED_FOR.items()))
def _(spark, d):
    index = Index(spark, store.folder(spark)).append(table(spark, d, "documents"), ("lang", "source"))
    return boolean_search.matches(index, {q: x for q, (x, _) in ASKED_FOR.items()}, {"bracket": "source"})


# --- vectors by cell


def _probes(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select((F.col("vec_id") + 1).cast("int").alias("query_id"), F.col("embedding").alias("vector"))


@query("vector_index_topk", f"WITH {_dense_sql(20)} SELECT query_id, doc_id, rank, round(similarity, 6) AS similarity FROM dn")
def _(spark, d):
    index = VectorIndex.build(table(spark, d, "embeddings"), store.folder(spark))
    return index.search(_probes(spark, d), 20, exact=True)[0].withColumn("similarity", F.round("similarity", 6))


@query("vector_index_topk_filtered", f"WITH {_dense_sql(20, 'a.label = 1')} SELECT query_id, doc_id, rank, round(similarity, 6) AS similarity FROM dn")
def _(spark, d):
    index = VectorIndex.build(table(spark, d, "embeddings"), store.folder(spark), filters=("label",))
    return index.search(_probes(spark, d), 20, F.col("label") == 1, exact=True)[0].withColumn("similarity", F.round("similarity", 6))


# --- dictionary hits, pages


@query("dictionary_hits", f"WITH t AS (SELECT DISTINCT term FROM (SELECT unnest({sql_tokens('text')}) AS term FROM benchmark) WHERE len(term) >= 5) SELECT doc_id, term, strpos(lower(text), term) AS first FROM documents JOIN t ON contains(lower(text), term)")
def _(spark, d):
    terms = table(spark, d, "benchmark").select(F.explode(T.tokens("text")).alias("term")).where("length(term) >= 5")
    return dictionary.hits(table(spark, d, "documents"), terms, "doc_id", "text").select("doc_id", "term", "first")


_BY_LENGTH = "r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank, ceil(count(*) OVER () / 15)::BIGINT AS total_pages FROM documents)"


@query("page_by_rank", f"WITH {_BY_LENGTH} SELECT doc_id, n_chars, rank, total_pages FROM r WHERE rank BETWEEN 76 AND 90")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return order.page(docs, 6, 15, [F.desc_nulls_last("n_chars"), "doc_id"])


@query("page_by_token", f"WITH {_BY_LENGTH} SELECT doc_id, n_chars FROM r WHERE rank BETWEEN 31 AND 45")
def _(spark, d):
    docs, token = table(spark, d, "documents").select("doc_id", "n_chars"), None
    for _ in range(2):
        token = order.token_of(order.page_after(docs, token, 15, "n_chars", "doc_id"), "n_chars", "doc_id")
    return order.page_after(docs, token, 15, "n_chars", "doc_id")


@query("value_ranks", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events")
def _(spark, d):
    return order.numbered(table(spark, d, "events").select("event_id", "event_type", "value"), [F.desc_nulls_last("value"), "event_id"], ["event_type"]).select("event_id", "event_type", "rank")
