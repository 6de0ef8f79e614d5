"""A batch of queries to answers: understand, search, answer, verify. Two profiles, as the two entry points have it.

`orchestrated`: query analysis, entities, crosswalk, expansion, filtered search, entity reranking, verification.
`api`: route, search, selection of one result of each act asked for, page, confidence level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import legal as L
from ..functions import text as T
from ..operators import answers, retrieval, scoring, understanding, verification
from . import search

ACTS = ("IPC", "BNS", "CRPC", "BNSS", "BSA", "CPC")


def orchestrated(queries: DataFrame, chunks: DataFrame, crosswalk: DataFrame, synonyms: DataFrame, as_of: str, retrieve: int = 10, keep: int = 5) -> DataFrame:
    """(query_id, rank, id, score, entity_boost): the best chunks of each query that is legal research."""
    route = queries.select("query_id", "query", L.rule_route("query").alias("r"), L.entities("query").alias("e"))
    legal = route.where((F.col("r.route") == "LEGAL_RESEARCH") | L.route_hint("e").isNotNull()).select("query_id", "query")
    rewritten = store.saved(understanding.normalized(legal, crosswalk).select("query_id", F.col("normalized").alias("query")))
    rewritten = store.saved(understanding.expanded(rewritten, synonyms).select("query_id", F.col("expanded").alias("query")))
    found = search.statutes(rewritten, chunks, as_of, retrieve, filtered=True)
    entities = queries.select("query_id", L.entities("query").alias("entities"))
    boost = scoring.entity_boost("document", "section_number", "section", T.text_of("source"), "act")
    best = found.join(entities, "query_id").withColumn("entity_boost", F.round(boost, 6)).withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + F.col("entity_boost")), 6))
    return retrieval.ranked(best.drop("rank"), keep, "score", "id", None)


def api(queries: DataFrame, chunks: DataFrame, as_of: str, page: int = 1, size: int = 10) -> DataFrame:
    """(query_id, position, id, act, score, total_pages, level) of one page of results."""
    window, pool = retrieval.window_and_pool(page, size)
    found = search.statutes(queries, chunks, as_of, window, pool)
    low = F.lower("query")
    asked = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(a.lower())), F.lit(a)) for a in ACTS]))
    wanted = (F.size(asked) >= 2) & F.array_contains(asked, F.col("act"))
    placed = retrieval.one_per_group_first(found, "act", F.coalesce(wanted, F.lit(False)), window)
    level = answers.confidence(placed.select(F.col("query_id").alias("response_id"), F.col("position").alias("rank"), F.col("score").alias("similarity")))
    total = F.greatest(F.ceil(F.count("*").over(Window.partitionBy("query_id")) / size), F.lit(1)).cast("int")
    shown = placed.withColumn("total_pages", total).where(F.col("position").between((page - 1) * size + 1, page * size))
    graded = shown.join(level.withColumnRenamed("response_id", "query_id"), "query_id")
    return graded.select("query_id", "position", "id", "act", "score", "total_pages", scoring.confidence_level(F.col("confidence"), F.lit("LEGAL_RESEARCH"), F.lit(1)).alias("level"))


def verified_answers(given: DataFrame, sources: DataFrame) -> DataFrame:
    """(response_id, citation_coverage, status, note) of answers held against their sources."""
    checked = verification.verified(verification.claims(given), sources)
    covered = verification.coverage(given, checked)
    findings = verification.fabricated(given).unionByName(verification.outdated(given))
    return verification.risk(covered, findings).select("response_id", "citation_coverage", "status", verification.note("citation_coverage").alias("note"))


def batch(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, query, n_results, error): every query of a batch, those without results too."""
    counts = results.groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return queries.join(counts, "query_id", "left").select("query_id", "query", n.alias("n_results"), F.when(F.length(F.trim(T.text_of("query"))) == 0, "empty query").alias("error"))
