"""Queries of retrieval, fusion, scoring, selection and paging. documents are the chunks, embeddings their vectors (doc_id = vec_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from .. import resources as R
from ..functions import legal as L
from ..functions import text as T
from ..operators import retrieval as S
from ..operators import scoring
from ..plans import search
from .common import sql_collapse, sql_list, sql_map, sql_tokens, table

QUERIES: dict = {}

#: Literal queries over the synthetic texts.
ASKED = [(1, "the thing and tion"), (2, "queen enou the the"), (3, "ciónes el Boasrr"), (4, "nothinglikethis")]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, query string")


_Q = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") v(query_id, query))"


def _bm25_sql(where: str = "TRUE") -> str:
    return f"""{_Q}, qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens('query')}) AS term FROM asked) GROUP BY ALL),
    dt AS MATERIALIZED (SELECT doc_id, {sql_tokens('text')} AS w FROM documents WHERE {where}), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dt),
    ps AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM ps GROUP BY term),
    bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avgdl, 1))) * qtf) AS score
        FROM ps JOIN df USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY ALL),
    br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank,
        CASE WHEN max(score) OVER q <= min(score) OVER q THEN 1.0 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END::DOUBLE AS norm FROM bm WINDOW q AS (PARTITION BY query_id))"""


@query("bm25_topk", f"WITH {_bm25_sql()} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM br WHERE rank <= 30")
def _(spark, d):
    return S.ranked(S.bm25(S.query_terms(asked(spark)), table(spark, d, "documents")), 30).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("bm25_minmax", f"WITH {_bm25_sql()} SELECT query_id, doc_id, round(norm, 6) AS normalized_score FROM br WHERE rank <= 30")
def _(spark, d):
    scored = S.min_max(S.bm25(S.query_terms(asked(spark)), table(spark, d, "documents")))
    return S.ranked(scored, 30).select("query_id", "doc_id", F.round("normalized_score", 6).alias("normalized_score"))


@query("bm25_filtered_lang", f"""WITH {_bm25_sql("lang = 'en'")} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM br WHERE rank <= 200""")
def _(spark, d):
    return S.ranked(S.bm25(S.query_terms(asked(spark)), table(spark, d, "documents").where("lang = 'en'")), 200).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_COS = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) + {eps})"


def _dense_sql(k: int, where: str = "TRUE", eps: str = "0", probes: str = "vec_id % 20 = 0") -> str:
    return f"""dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, doc_id)::INT AS rank FROM (SELECT b.vec_id::INT + 1 AS query_id, a.vec_id AS doc_id, {_COS.format(eps=eps)} AS similarity
        FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE {probes}) b WHERE {where}) QUALIFY rank <= {k})"""


def _probes(spark, d, where: str = "vec_id % 20 = 0"):
    return table(spark, d, "embeddings").where(where).select((F.col("vec_id") + 1).cast("int").alias("query_id"), F.col("embedding").alias("vector"))


@query("dense_topk", f"WITH {_dense_sql(20)} SELECT query_id, doc_id, rank, round(similarity, 6) AS similarity FROM dn")
def _(spark, d):
    return S.dense(_probes(spark, d), table(spark, d, "embeddings"), 20).withColumn("similarity", F.round("similarity", 6))


@query("dense_topk_filtered", f"WITH {_dense_sql(20, 'a.label = 1', '1e-8')} SELECT query_id, doc_id, rank, round(similarity, 6) AS similarity FROM dn")
def _(spark, d):
    return S.dense(_probes(spark, d), table(spark, d, "embeddings"), 20, 1e-8, where=F.col("label") == 1).withColumn("similarity", F.round("similarity", 6))


#: The vectors of the four literal queries.
_FOUR = "vec_id < 4"
_FUSED = f"""{_bm25_sql()}, {_dense_sql(30, probes=_FOUR)}, fu AS (SELECT coalesce(s.query_id, b.query_id) AS query_id, coalesce(s.doc_id, b.doc_id) AS doc_id, s.rank AS semantic_rank, b.rank AS bm25_rank,
    coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS rrf_score, coalesce(b.norm, 0) AS bm25_score, s.similarity FROM dn s FULL JOIN (SELECT * FROM br WHERE rank <= 30) b ON s.query_id = b.query_id AND s.doc_id = b.doc_id)"""


@query("rrf_fusion", f"WITH {_FUSED} SELECT query_id, doc_id, semantic_rank, bm25_rank, round(rrf_score, 6) AS rrf_score FROM fu")
def _(spark, d):
    lexical = S.ranked(S.bm25(S.query_terms(asked(spark)), table(spark, d, "documents")), 30)
    return S.fused(S.dense(_probes(spark, d, _FOUR), table(spark, d, "embeddings"), 30), lexical).select("query_id", "doc_id", "semantic_rank", "bm25_rank", F.round("rrf_score", 6).alias("rrf_score"))


_HYBRID = f"""{_FUSED}, sc AS (SELECT fu.*, coalesce(greatest(0, least(1, similarity / greatest(max(similarity) OVER (PARTITION BY query_id), 1e-9))), 0) AS semantic_score FROM fu),
    rr AS (SELECT *, round(greatest(0, least(1, 12 * rrf_score + 0.30::DOUBLE * bm25_score + 0.25::DOUBLE * semantic_score)), 6) AS score FROM sc)"""


@query("fallback_rerank", f"WITH {_HYBRID} SELECT query_id, doc_id, score FROM rr")
def _(spark, d):
    return search.candidates(asked(spark), table(spark, d, "documents"), _probes(spark, d, _FOUR), table(spark, d, "embeddings"), 30).select("query_id", "doc_id", F.col("reranker_score").alias("score"))


@query("hybrid_search", f"""WITH {_HYBRID}, dd AS (SELECT rr.*, dc.source, dc.text, row_number() OVER (PARTITION BY query_id, coalesce(dc.source, ''), md5(substring(lower({sql_collapse('dc.text')}), 1, 300)) ORDER BY score DESC, rr.doc_id) AS n FROM rr LEFT JOIN documents dc ON dc.doc_id = rr.doc_id)
    SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM dd WHERE n = 1 QUALIFY rank <= 10""")
def _(spark, d):
    return search.hybrid(asked(spark), table(spark, d, "documents"), _probes(spark, d, _FOUR), table(spark, d, "embeddings"), 10, 30).select("query_id", "doc_id", "source", "score", "rank")


@query("metadata_filter_relax", """WITH w AS (SELECT * FROM (VALUES (1, 'en', 'src1'), (2, 'xx', 'src2'), (3, 'xx', 'nowhere')) v(query_id, lang, source)),
    t AS (SELECT query_id, doc_id, CASE WHEN d.lang = w.lang AND d.source = w.source THEN 1 WHEN d.source = w.source THEN 2 ELSE 3 END AS tier FROM documents d CROSS JOIN w)
    SELECT query_id, doc_id, tier FROM t QUALIFY tier = min(tier) OVER (PARTITION BY query_id)""")
def _(spark, d):
    wanted = spark.createDataFrame([(1, "en", "src1"), (2, "xx", "src2"), (3, "xx", "nowhere")], "query_id int, w_lang string, w_source string")
    pairs = table(spark, d, "documents").select("doc_id", "lang", "source").crossJoin(wanted)
    strict = (F.col("lang") == F.col("w_lang")) & (F.col("source") == F.col("w_source"))
    return S.relaxed(pairs, strict, F.col("source") == F.col("w_source")).select("query_id", "doc_id", "tier")


_RANKED = "r AS (SELECT 1 AS query_id, doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 100)"


def _by_length(spark, d):
    docs = table(spark, d, "documents").select(F.lit(1).alias("query_id"), "doc_id", "source", F.col("n_chars").alias("score"))
    return S.ranked(docs, 100, digits=None).select("query_id", "doc_id", "source", "rank")


@query("act_diverse_selection", f"""WITH {_RANKED}, m AS (SELECT *, source IN ('src1', 'src3', 'src7') AND row_number() OVER (PARTITION BY source ORDER BY rank) = 1 AS lead FROM r)
    SELECT query_id, doc_id, source, rank, row_number() OVER (ORDER BY lead DESC, CASE WHEN lead THEN source END, rank)::INT AS position FROM m QUALIFY position <= 12""")
def _(spark, d):
    return S.one_per_group_first(_by_length(spark, d), "source", F.col("source").isin("src1", "src3", "src7"), 12)


@query("page_slice", f"WITH {_RANKED} SELECT doc_id, rank, ceil(count(*) OVER () / 15)::INT AS total_pages FROM r QUALIFY rank BETWEEN 31 AND 45")
def _(spark, d):
    return S.page_of(_by_length(spark, d), 3, 15).select("doc_id", "rank", "total_pages")


@query("route_by_vector", """WITH c AS (SELECT label, list(v ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
    s AS (SELECT vec_id, c.label, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * c.v[i])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(c.v, lambda x: x * x)))) AS sim FROM embeddings e CROSS JOIN c)
    SELECT vec_id, label, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, label) = 1""")
def _(spark, d):
    return search.nearest_prototype(table(spark, d, "embeddings"))


# --- statutes


@query("chunk_citations")
def _(spark, d):
    chunks = fixtures.over(spark, d, "chunks")
    return chunks.select("id", L.citation_section("document").alias("section"), L.act_code("act_name", "source", "document").alias("act"))


QUERIES["chunk_citations"] = (
    QUERIES["chunk_citations"][0],
    f"""WITH {fixtures.over_sql('chunks')}, x AS (SELECT *, lower(source) || ' ' || lower(substring(document, 1, 300)) AS around FROM chunks)
    SELECT id, lower(coalesce(nullif(regexp_extract(document, '(?i)\\[s\\s*(\\d{{1,4}}[a-z]?)(?:\\.\\d+)?\\]', 1), ''), nullif(regexp_extract(document, '(?i)^\\s*(\\d{{1,4}}[a-z]?)\\.\\s', 1), ''), nullif(regexp_extract(document, '(?i)\\b(?:section|sec\\.?|s\\.)\\s*(\\d{{1,4}}[a-z]?)\\b', 1), ''))) AS section,
        coalesce(element_at({sql_map(R.ACT_CODES)}, lower(act_name))[1], upper(act_name), CASE {' '.join(f"WHEN contains(around, '{a}') THEN '{c}'" for a, c in R.ACT_CODES.items())} WHEN contains(around, 'evidence') AND contains(around, 'bharatiya') THEN 'BSA' END) AS act FROM x""",
)


@query("query_filters", f"""WITH {fixtures.over_sql('asked')}, p AS (SELECT query_id, list_transform(regexp_extract_all(query, '(?i)\\b(?:section|sec\\.?|s\\.)\\s*(\\d{{1,4}}[a-z]?)\\b', 1), lambda x: lower(x)) AS s,
    list_transform(regexp_extract_all(query, '(?i){L.ACT.replace("(", "(", 1)}', 1), lambda x: coalesce(element_at({sql_map(R.ACT_CODES)}, lower(x))[1], upper(x))) AS a FROM asked),
    u AS (SELECT query_id, list_filter(s, lambda x, i: list_position(s, x) = i) AS s, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM p)
    SELECT query_id, array_to_string(s, ',') AS sections, array_to_string(a, ',') AS acts, len(s) + len(a) > 0 AS cited FROM u""")
def _(spark, d):
    p = fixtures.over(spark, d, "asked").select("query_id", L.parsed_query("query").alias("p"))
    return p.select("query_id", F.array_join("p.section_numbers", ",").alias("sections"), F.array_join("p.acts", ",").alias("acts"), F.col("p.has_legal_citation").alias("cited"))


@query("exact_act_names", f"""WITH {fixtures.over_sql('asked')}, p AS (SELECT query_id, unnest(a) AS act, generate_subscripts(a, 1) AS i FROM (SELECT query_id, list_transform(regexp_extract_all(query, '(?i){L.ACT}', 1), lambda x: coalesce(element_at({sql_map(R.ACT_CODES)}, lower(x))[1], upper(x))) AS a FROM asked)),
    n(k, names) AS (VALUES {', '.join("('" + k + "', " + sql_list(v) + ")" for k, v in R.ACT_FULL_NAMES.items())}), x AS (SELECT query_id, i, unnest(coalesce(n.names, [act])) AS name, generate_subscripts(coalesce(n.names, [act]), 1) AS j FROM p LEFT JOIN n ON n.k = lower(act)),
    u AS (SELECT query_id, name, min(i * 100 + j) AS o FROM x GROUP BY ALL) SELECT asked.query_id, coalesce(string_agg(name, '; ' ORDER BY o), '') AS names FROM asked LEFT JOIN u ON u.query_id = asked.query_id GROUP BY 1""")
def _(spark, d):
    p = fixtures.over(spark, d, "asked").select("query_id", L.query_acts("query").alias("acts"))
    return p.select("query_id", F.array_join(L.full_act_names(F.col("acts")), "; ").alias("names"))


@query("legal_boosts")
def _(spark, d):
    return search.scored_chunks(fixtures.frame(spark, "asked"), fixtures.over(spark, d, "chunks"), "2024-07-01").select("query_id", "id", "boost_score", F.array_join("reasons", "; ").alias("reasons"))


@query("statute_search")
def _(spark, d):
    return search.statutes(fixtures.frame(spark, "asked"), fixtures.over(spark, d, "chunks"), "2024-07-01", 5).select("query_id", "rank", "id", "score", F.array_join("reasons", "; ").alias("reasons"))


@query("filtered_statute_search")
def _(spark, d):
    return search.statutes(fixtures.frame(spark, "asked"), fixtures.over(spark, d, "chunks"), "2024-07-01", 5, filtered=True).select("query_id", "rank", "id", "tier", "score")


@query("entity_rerank")
def _(spark, d):
    return search.entity_reranked(fixtures.frame(spark, "asked"), fixtures.over(spark, d, "chunks")).select("query_id", "id", "entity_boost", "tier")


@query("answer_confidence", """WITH r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank, (vec_id % 100) / 100.0::DOUBLE AS sim FROM embeddings QUALIFY rank <= 5)
    SELECT label, round(sum(sim / rank) / sum(1.0::DOUBLE / rank) * 100)::INT AS confidence, CASE WHEN round(sum(sim / rank) / sum(1.0::DOUBLE / rank) * 100) >= 75 THEN 'high' WHEN round(sum(sim / rank) / sum(1.0::DOUBLE / rank) * 100) >= 50 THEN 'medium' ELSE 'low' END AS level FROM r GROUP BY label""")
def _(spark, d):
    from pyspark.sql import Window

    from ..operators import answers

    ranked = table(spark, d, "embeddings").select(F.col("label").alias("response_id"), ((F.col("vec_id") % 100) / F.lit(100.0)).alias("similarity"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"))
    out = answers.confidence(ranked).withColumnRenamed("response_id", "label")
    return out.select("label", "confidence", scoring.confidence_level(F.col("confidence"), F.lit("LEGAL_RESEARCH"), F.lit(1)).alias("level"))


@query("legal_intent", f"""SELECT conv_id, turn, len(list_filter({sql_tokens('text')}, lambda x: list_contains({sql_list(R.LEGAL_INTENT_WORDS)}, x))) > 0 OR len(list_filter({sql_list(R.LEGAL_INTENT_PHRASES)}, lambda p: contains(lower(coalesce(text, '')), p))) > 0 AS legal FROM conversations""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", L.is_legal_query("text").alias("legal"))


@query("display_scores", "SELECT doc_id, CASE WHEN x <= 0 THEN 0 WHEN x <= 1 THEN x ELSE least(x / 100, 1) END AS shown, round(1 / (1 + exp(-x / 50)), 6) AS squashed FROM (SELECT doc_id, (doc_id % 300 - 50)::DOUBLE AS x FROM documents)")
def _(spark, d):
    x = (F.col("doc_id") % 300 - 50).cast("double")
    return table(spark, d, "documents").select("doc_id", T.display_score(x).alias("shown"), F.round(T.sigmoid(x / 50), 6).alias("squashed"))
