"""Scores of candidates: boosts, hybrid score, heuristic and entity reranking, confidence levels, precedent strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import legal as L
from ..functions import text as T


def _reasons(*pairs) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), reason) for test, reason in pairs]), lambda x: x.isNotNull())


def _sum(*pairs) -> Column:
    return sum((F.when(F.coalesce(test, F.lit(False)), weight).otherwise(0.0) for test, weight in pairs), F.lit(0.0))


def legal_boost(section, act, document, sections: Column, acts: Column) -> tuple[Column, Column]:
    """Boost and reasons: act 0.10, section 0.22, both 0.18 more, section named in the text 0.08."""
    in_acts = (F.size(acts) > 0) & F.array_contains(acts, act)
    in_sections = (F.size(sections) > 0) & F.array_contains(sections, section)
    named = (F.size(sections) > 0) & L.has_section_reference(document, sections)
    boost = _sum((in_acts, 0.10), (in_sections, 0.22), (in_acts & in_sections, 0.18), (named, 0.08))
    return boost, _reasons((in_acts, F.concat(F.lit("act-match:"), act)), (in_sections, F.concat(F.lit("section-match:"), section)), (in_acts & in_sections, F.concat(F.lit("citation-match:"), act, F.lit("-"), section)), (named, F.lit("section-text-hit")))


def concept_boost(query, haystack, terms: Column) -> tuple[Column, Column]:
    """Boost and reason by how many of the query's concept terms the text has; 0.34 where it states the punishment asked for."""
    hay = F.lower(haystack)
    matched = F.filter(terms, lambda t: F.rlike(hay, F.concat(F.lit(r"\b"), t, F.lit(r"\b"))))
    punished = F.filter(matched, lambda t: F.contains(hay, F.concat(F.lit("punishment for "), t)) | F.contains(hay, F.concat(t, F.lit(" shall be punished"))))
    asks = F.contains(F.lower(T.text_of(query)), F.lit("punishment")) & (F.size(punished) > 0)
    none = F.size(terms) == 0
    every = F.size(matched) == F.size(terms)
    boost = F.when(none, 0.0).when(asks, 0.34).when(every, 0.24).when(F.size(matched) > 0, 0.12).otherwise(-0.10)
    listed = F.array_join(matched, ",")
    reason = F.when(none, F.lit(None).cast("string")).when(asks, F.concat(F.lit("concept-punishment-match:"), F.try_element_at(punished, F.lit(1)))).when(every, F.concat(F.lit("concept-match:"), listed)).when(F.size(matched) > 0, F.concat(F.lit("concept-partial:"), listed)).otherwise("concept-missing")
    return boost, reason


def current_law_boost(act, acts: Column, cited: Column) -> Column:
    return F.when(~cited, 0.0).when(act == "BNS", 0.06).when((act == "IPC") & F.array_contains(acts, "BNS"), -0.04).otherwise(0.0)


def jurisdiction_boost(jurisdiction, decided: Column, as_of) -> Column:
    """Supreme court 0.03, high court 0.015; and 0.03 less a 3650th for each day of age, down to 0."""
    where = F.lower(F.trim(T.text_of(jurisdiction)))
    court = F.when(F.contains(where, F.lit("supreme court")), 0.03).when(F.contains(where, F.lit("high court")), 0.015).otherwise(0.0)
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), decided), F.lit(0))
    return court + F.when(decided.isNotNull(), F.greatest(F.lit(0.0), F.lit(0.03) - F.least(age / F.lit(3650.0), F.lit(0.03)))).otherwise(0.0)


def source_type_boost(kind) -> Column:
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.when(c == "bare_act", 0.05).when(c == "commentary", -0.02).otherwise(0.0)


def heuristic_score(rrf, bm25, semantic, boost) -> Column:
    """12 rrf + 0.30 bm25 + 0.25 semantic + boost, within 0 and 1."""
    return T.clamp(F.lit(12.0) * rrf + F.lit(0.30) * bm25 + F.lit(0.25) * semantic + boost)


def reranked(candidates: DataFrame, model: Column | None = None) -> DataFrame:
    """candidates(query_id, ..., rrf_score, bm25_score, semantic_score, boost_score) with reranker_score: a model's logit through a sigmoid, or the heuristic."""
    score = T.sigmoid(model) if model is not None else heuristic_score(F.col("rrf_score"), F.col("bm25_score"), F.col("semantic_score"), F.col("boost_score"))
    return candidates.withColumn("reranker_score", F.round(score, 6))


def boosted(candidates: DataFrame, as_of: str) -> DataFrame:
    """candidates with the columns of a chunk and of a parsed query (parsed) with boost_score and reasons."""
    sections, acts = F.col("parsed.section_numbers"), F.col("parsed.acts")
    legal, legal_reasons = legal_boost(F.col("section"), F.col("act"), "document", sections, acts)
    hay = F.concat_ws(" ", T.text_of("document"), T.text_of("source"), T.text_of("act_name"), T.text_of("section_title"))
    concept, concept_reason = concept_boost("query", hay, F.col("parsed.concept_terms"))
    current = current_law_boost(F.col("act"), acts, F.col("parsed.has_legal_citation"))
    place = jurisdiction_boost("jurisdiction", T.parse_date("decision_date"), as_of)
    kind = source_type_boost("source_type")
    reasons = F.concat(
        F.filter(F.array(concept_reason, F.when(current > 0, "current-law-preferred").when(current < 0, "legacy-law-deprioritized"), F.when(F.col("source_type") == "bare_act", "source:bare-act").when(F.col("source_type") == "commentary", "source:commentary")), lambda x: x.isNotNull()),
        legal_reasons,
    )
    return candidates.withColumns({"boost_score": F.round(legal + concept + current + place + kind, 6), "reasons": reasons})


def entity_boost(document, section_number, citation_section, act_text: Column, act, e: str = "entities", weights: dict | None = None) -> Column:
    """Section 0.25 by metadata, 0.15 by citation, 0.05 by text, of the first that is strong; act, topic and article by weight."""
    w = {"act": 0.10, "topic": 0.05, "article": 0.10} | (weights or {})
    doc = F.lower(T.text_of(document))
    asked = F.concat(F.col(f"{e}.sections"), F.col(f"{e}.ipc_sections"), F.col(f"{e}.bns_sections"))
    own, cited = F.lower(T.text_of(section_number)), F.lower(T.text_of(citation_section))
    grade = F.transform(asked, lambda s: F.when((own != "") & (own == s), 0.25).when(cited == s, 0.15).when(F.rlike(doc, F.concat(F.lit(r"section\s+"), s)) | F.rlike(doc, F.concat(F.lit(r"s\.?\s*"), s)), 0.05).otherwise(0.0))
    strong = F.try_element_at(F.filter(grade, lambda g: g >= 0.15), F.lit(1))
    section = F.coalesce(strong, F.array_max(grade), F.lit(0.0))

    def words(table: dict, name: Column, fallback: Column) -> Column:
        known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(y.lower()) for y in v]))])
        return F.coalesce(F.try_element_at(known, name), F.array(fallback))

    around = F.concat_ws("\n", doc, F.lower(act_text), F.replace(F.lower(act_text), F.lit("_"), F.lit(" ")), F.lower(T.text_of(act)))
    by_act = F.exists(F.col(f"{e}.acts"), lambda a: F.exists(words(R.RERANK_ACT_WORDS, a, F.lower(a)), lambda k: F.contains(around, k)))
    by_topic = F.exists(F.col(f"{e}.topics"), lambda t: F.exists(words(R.RERANK_TOPIC_WORDS, t, F.replace(t, F.lit("_"), F.lit(" "))), lambda k: F.contains(doc, k)))
    by_article = F.exists(F.col(f"{e}.articles"), lambda a: F.rlike(doc, F.concat(F.lit(r"article\s+"), a)))
    return section + _sum((by_act, w["act"]), (by_topic, w["topic"]), (by_article, w["article"]))


def entity_tier(boost: Column) -> Column:
    return F.when(boost >= 0.15, "entity-boost-strong").when(boost >= 0.10, "entity-boost-medium").when(boost > 0, "entity-boost-light")


def precedent_strength(bench_size, court) -> Column:
    return F.least(F.least(F.col(bench_size) / F.lit(5.0), F.lit(1.0)) * 0.3 + F.when(F.col(court) == "supreme_court", 0.5).otherwise(0.2) + 0.2, F.lit(1.0))


def confidence_level(score, route, results) -> Column:
    return F.when(route != "LEGAL_RESEARCH", "unknown").when(results == 0, "low").when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")
