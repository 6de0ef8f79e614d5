"""Whole searches as lazy plans over a batch of queries: understand, retrieve, fuse, score, drop duplicates, rerank, cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import legal as L
from ..functions import text as T
from ..operators import retrieval as S
from ..operators import scoring
from ..sources import readers


def candidates(queries: DataFrame, docs: DataFrame, probes: DataFrame, vectors: DataFrame, pool: int) -> DataFrame:
    """(query_id, doc_id, rrf_score, bm25_score, semantic_score, boost_score, reranker_score) of both branches, each cut to the pool."""
    lexical = S.ranked(S.min_max(S.bm25(S.query_terms(queries), docs)), pool)
    semantic = S.dense(probes, vectors, pool)
    both = S.fused(semantic, lexical)
    return scoring.reranked(both.withColumns({"bm25_score": F.coalesce("bm25_score", F.lit(0.0)), "semantic_score": S.semantic_score(), "boost_score": F.lit(0.0)}))


def hybrid(queries: DataFrame, docs: DataFrame, probes: DataFrame, vectors: DataFrame, k: int = 5, pool: int = 30) -> DataFrame:
    """The k best documents of each query, one of each (source, normalised text): (query_id, doc_id, source, score, rank)."""
    scored = candidates(queries, docs, probes, vectors, pool).select("query_id", "doc_id", F.col("reranker_score").alias("score"))
    # two pools a query meet the texts: few rows, unless the batch is large; only texts that are met are hashed
    few = queries.limit(S.FEW_ROWS // (2 * pool) + 1).count() <= S.FEW_ROWS // (2 * pool)
    texts = docs.select("doc_id", "source", "text").join(F.broadcast(scored.select("doc_id").distinct()) if few else scored.select("doc_id").distinct(), "doc_id", "left_semi")
    found = scored.join(texts.select("doc_id", "source", F.md5(T.normalized_prefix("text")).alias("prefix")), "doc_id", "left")
    first = S.first_occurrences(S.ranked(found, digits=None), F.struct(F.coalesce("source", F.lit("")), "prefix"))
    return S.ranked(first.drop("rank"), k, digits=None).select("query_id", "doc_id", "source", "score", "rank")


def statutes(
    queries: DataFrame, chunks: DataFrame, as_of: str, k: int = 5, pool: int = 30, filtered: bool = False, by_page: bool = True, probes: DataFrame | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """Ranked chunks for queries about statutes: BM25 and, with probes(query_id, embedding) and vectors(vec_id, embedding), nearest vectors, fused; boosts, duplicates dropped by page, heuristic reranking.

    filtered: only chunks of the sections and acts a query names, acts given up first, then sections; both branches rank what is left and
    are then cut to the pool, so a chunk that fits is never lost to others that don't. by_page: one chunk of a page, as its hash names it; else one of each text.
    """
    texts, chunks = chunks, readers.with_derived(chunks)
    parsed = queries.select("query_id", "query", L.parsed_query("query").alias("parsed"))

    def narrowed(hits: DataFrame) -> DataFrame:
        """Of hits(query_id, doc_id, ...), those of the best tier that each query has."""
        placed = hits.join(chunks.select(F.col("id").alias("doc_id"), "act", "section_number"), "doc_id").join(_few(parsed.select("query_id", "parsed")), "query_id")
        strict, loose = _fit()
        marked = store.saved(placed.select(*hits.columns, strict.alias("_strict"), loose.alias("_loose")))  # scored once, read for the best tier and for its hits
        return S.relaxed(marked, F.col("_strict"), F.col("_loose")).select(*hits.columns)

    lexical = S.bm25(S.query_terms(queries), chunks, "id", "document")
    lexical = S.ranked(S.min_max(narrowed(lexical) if filtered else store.saved(lexical)), pool)
    if probes is not None:
        near = S.dense(probes, vectors, None if filtered else pool)
        near = S.ranked(narrowed(near).drop("rank"), pool, "similarity") if filtered else near
        found = S.fused(near, lexical).withColumn("semantic_score", S.semantic_score())
    else:
        found = lexical.select("query_id", "doc_id", (F.lit(1.0) / (S.RRF_K + F.col("rank"))).alias("rrf_score"), F.col("normalized_score").alias("bm25_score"), F.lit(0.0).alias("semantic_score"))
    found = found.select("query_id", F.col("doc_id").alias("id"), "rrf_score", F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), "semantic_score")
    found = _with_chunks(found, texts).join(_few(parsed), "query_id")
    strict, loose = _fit()
    found = found.withColumn("tier", F.when(strict, 1).when(loose, 2).otherwise(3) if filtered else F.lit(0))
    scored = scoring.reranked(scoring.boosted(found, as_of)).withColumn("order", F.round(F.col("rrf_score") + F.col("boost_score"), 6))
    text_key = F.concat_ws("|", "source", F.col("page").cast("string"), T.normalized_prefix("document"))
    first = S.first_occurrences(S.ranked(scored, None, "order", "id", None), F.coalesce(F.col("page_hash"), text_key) if by_page else text_key)
    return S.ranked(first.drop("rank").withColumnRenamed("reranker_score", "score"), k, "score", "id", None)


def _with_chunks(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """found(query_id, id, ...) with the chunks' columns and what is derived from their texts: only texts that are found are looked at."""
    found = store.saved(found)
    ids = S.broadcast_if_few(found.select("id").distinct())
    return found.join(readers.with_derived(chunks.join(ids, "id", "left_semi")), "id")


def _few(parsed: DataFrame) -> DataFrame:
    """What is read from the queries, marked for broadcast if they are few."""
    return S.broadcast_if_few(parsed, 10_000)


def _fit() -> tuple[Column, Column]:
    """Whether a chunk is of the sections and acts that the query names, and whether it is of the sections."""
    names = L.full_act_names(F.col("parsed.acts"))
    in_act = F.exists(names, lambda n: F.startswith(n, F.coalesce(F.col("act"), F.lit("?")))) | F.array_contains(F.col("parsed.acts"), F.col("act"))
    no_act, no_section = F.size("parsed.acts") == 0, F.size("parsed.section_numbers") == 0
    in_section = no_section | F.array_contains(F.col("parsed.section_numbers"), F.lower("section_number"))
    return F.coalesce(in_section & (no_act | in_act), F.lit(False)), F.coalesce(in_section & ~no_section, F.lit(False))


def scored_chunks(queries: DataFrame, chunks: DataFrame, as_of: str, pool: int = 30) -> DataFrame:
    """The lexical candidates of each query, `pool` at most, boosted."""
    parsed = queries.select("query_id", "query", L.parsed_query("query").alias("parsed"))
    found = S.ranked(S.bm25(S.query_terms(queries), chunks, "id", "document"), pool).select("query_id", F.col("doc_id").alias("id"))
    return scoring.boosted(_with_chunks(found, chunks).join(_few(parsed), "query_id"), as_of)


def entity_reranked(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id, entity_boost, tier) of chunks by the entities that queries name. Queries that name none boost nothing and meet no chunk; the others go to where the chunks are, if they are few."""
    parsed = queries.select("query_id", "query", L.entities("query").alias("entities"))
    named = F.exists(F.array(*[F.size(f"entities.{e}") for e in ("sections", "ipc_sections", "bns_sections", "acts", "topics", "articles")]), lambda n: n > 0)
    pairs = readers.with_derived(chunks).drop("tokens").crossJoin(_few(store.saved(parsed.where(named))))
    boost = scoring.entity_boost("document", "section_number", "section", T.text_of("source"), "act")
    return pairs.withColumn("entity_boost", F.round(boost, 6)).where("entity_boost > 0").withColumn("tier", scoring.entity_tier(F.col("entity_boost")))


def nearest_prototype(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, similarity): the label whose mean vector is nearest by cosine. The means are a row for each label."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    scored = vectors.select("vec_id", "embedding").crossJoin(means).withColumn("similarity", T.cosine(F.col("embedding"), F.col("mean")))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.round("similarity", 9).desc(), "label"))).where("n = 1")
    return best.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def routed(queries: DataFrame, forward: Column, back: Column) -> DataFrame:
    """queries with entities, analysis, the rules' route and the route that is taken."""
    read = queries.select("*", L.entities("query").alias("entities"), L.analysis("query", forward, back).alias("analysis"), L.rule_route("query").alias("rules"))
    hint = L.route_hint()
    return read.withColumn("route", L.arbitrated_route(F.col("rules"), F.lit(None).cast("struct<route: string, confidence: double>"), hint, F.col("analysis")))
