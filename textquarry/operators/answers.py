"""Answers from ranked sources: payloads, excerpts, comparison tables, confidence, related provisions, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NOTHING, NO_SOURCE = "Not directly stated", "No direct source retrieved"
EXCERPT_WORDS = ("punish", "imprison", "fine", "theft", "section", "cognizable", "cognisable", "community service")


def best_excerpt(document) -> Column:
    """The first sentence on the punishment for theft, else the first of those that name most of EXCERPT_WORDS; 40 words at most."""
    said = F.filter(F.transform(F.split(T.collapse(document), r"(?<=[.!?])\s+"), F.trim), lambda x: x != "")
    told = F.try_element_at(F.filter(said, lambda x: F.contains(F.lower(x), F.lit("punishment for theft"))), F.lit(1))
    hits = lambda x: sum((F.contains(F.lower(x), F.lit(w)).cast("int") for w in EXCERPT_WORDS), F.lit(0))
    best = F.array_max(F.transform(said, lambda x, i: F.struct(hits(x).alias("hits"), (-i).alias("at"), x.alias("said"))))
    excerpt = F.coalesce(told, best["said"], F.substring(T.collapse(document), 1, 220))
    return F.replace(T.capped_words(excerpt, 40), F.lit('"'), F.lit("'"))


def document_type(structure_kind, source) -> Column:
    kind, name = F.lower(T.text_of(structure_kind)), F.lower(T.text_of(source))
    has = lambda c, x: F.contains(c, F.lit(x))
    return F.when(has(kind, "case") | has(name, "judgment"), "Case law").when(has(kind, "regulation"), "Regulation").when(has(kind, "commentary") | has(name, "textbook") | has(name, "ratanlal"), "Legal commentary").otherwise("Statute")


def payload(sources: DataFrame) -> DataFrame:
    """Ranked sources as they are shown: number, title, act, section, document_type, chunk, similarity, excerpt."""
    shown = F.when(F.col("similarity") <= 0, 0.0).when(F.col("similarity") <= 1, F.col("similarity")).otherwise(1.0)
    return sources.select(
        "response_id", F.col("rank").alias("number"), F.coalesce("title", "source", F.lit("Retrieved legal source")).alias("title"), "id", F.coalesce(F.nullif(F.upper("act"), F.lit("")), F.lit("LEGAL")).alias("act"),
        F.coalesce(F.nullif("section", F.lit("")), F.lit("unidentified")).alias("section"), document_type("structure_type", "source").alias("document_type"), (F.coalesce("chunk_index", F.col("rank") - 1) + 1).alias("chunk"),
        shown.alias("similarity"), best_excerpt("document").alias("excerpt"), T.collapse("document").alias("document"),
    )


def confidence(ranked: DataFrame) -> DataFrame:
    """(response_id, confidence): similarities of the first five weighted by 1 / rank, in percent."""
    return ranked.where("rank <= 5").groupBy("response_id").agg(F.round(F.sum(F.col("similarity") / F.col("rank")) / F.sum(F.lit(1.0) / F.col("rank")) * 100).cast("int").alias("confidence"))


POINTS = (
    (2, "Simple/basic offence punishment", ("punish", "imprison", "fine", "community service")),
    (3, "Repeat/aggravated offence punishment", ("subsequent", "repeat", "aggravated", "second", "again")),
    (4, "Cognisable status", ("cognizable", "cognisable", "bailable", "non-cognizable")),
)


def comparison(shown: DataFrame, least: float | None = 0.70) -> DataFrame:
    """(response_id, point, ipc, bns): what the two codes say on four points; points on which both say nothing are left out.

    A point's cell is the first source that has one of its words, else the side's first source. least: similarity of sources
    that count; None: all.
    """
    rows = shown if least is None else shown.where(F.col("similarity") >= least)
    sides = rows.withColumn("side", F.when(F.contains("act", F.lit("IPC")) | F.contains("act", F.lit("INDIAN PENAL CODE")), "ipc").when(F.contains("act", F.lit("BNS")) | F.contains("act", F.lit("BHARATIYA NYAYA SANHITA")), "bns")).where("side IS NOT NULL")
    best = F.max_by(F.struct("section", "number"), F.struct("similarity", -F.col("number")))
    mark = lambda s: F.concat(s["excerpt"], F.lit(" [§"), s["number"].cast("string"), F.lit("]"))
    cells = [F.concat(F.lit("Section "), best["section"], F.lit(" "), F.upper("side"), F.lit(" [§"), best["number"].cast("string"), F.lit("]")).alias("p1")]
    one = F.struct("excerpt", "number")
    for i, _, found in POINTS:
        has = T.contains_any(F.lower("document"), found)
        cells.append(mark(F.coalesce(F.min_by(F.when(has, one), F.when(has, F.col("number"))), F.min_by(one, "number"))).alias(f"p{i}"))
    by_side = sides.groupBy("response_id", "side").agg(*cells)
    ids = shown.select("response_id").distinct()
    for side in ("ipc", "bns"):
        ids = ids.join(by_side.where(F.col("side") == side).select("response_id", *[F.col(f"p{i}").alias(f"{side}{i}") for i in range(1, 5)]), "response_id", "left")
    names = ["Section reference", *(p for _, p, _ in POINTS)]
    table = F.array(*[F.struct(F.lit(n).alias("point"), F.coalesce(f"ipc{i}", F.lit(NO_SOURCE if i == 1 else NOTHING)).alias("ipc"), F.coalesce(f"bns{i}", F.lit(NO_SOURCE if i == 1 else NOTHING)).alias("bns")) for i, n in enumerate(names, 1)])
    return ids.select("response_id", F.inline(F.filter(table, lambda r: ~((r["ipc"] == NOTHING) & (r["bns"] == NOTHING)))))


def related(results: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, related): sections of the best hit's act or chapter, other than its own, distinct and sorted."""
    top = results.where("rank = 1").select("query_id", F.col("act").alias("t_act"), F.col("chapter").alias("t_chapter"), F.col("section").alias("t_section"))
    same = results.join(top, "query_id").where("(act = t_act OR chapter = t_chapter) AND section IS NOT NULL AND NOT (section <=> t_section)")
    return same.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.concat_ws(" ", F.lit("Section"), "section", "act"))), 1, limit).alias("related"))


def formatted(results: DataFrame) -> DataFrame:
    """(query_id, text): numbered lines with score, reasons and snippet."""
    label = F.concat_ws(" | ", F.coalesce("source", F.lit("Unknown Source")), F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit("?"))), "act", F.concat(F.lit("section "), F.col("section")))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), label, F.lit("\n   score="), F.format_string("%.3f", "score"), F.lit(" reasons="), F.coalesce(F.nullif(F.array_join("reasons", ", "), F.lit("")), F.lit("retrieved")), F.lit("\n   "), T.snippet("document"))
    return results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))


def context(sources: DataFrame, limit: int = 1500) -> DataFrame:
    """(response_id, context): labelled source texts for a model, cut and joined."""
    label = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.concat_ws(", ", "act", F.concat(F.lit("Section "), F.col("section")), F.concat(F.lit("Page "), F.col("page").cast("string"))), F.lit("]\n"), F.substring("document", 1, limit))
    return sources.groupBy("response_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("t")))), lambda x: x["t"]), "\n---\n").alias("context"))


def report(shown: DataFrame, queries: DataFrame) -> DataFrame:
    """(response_id, report): the whole text answer, sources unfiltered, with its confidence."""
    entry = F.concat(F.lit("[§"), F.col("number").cast("string"), F.lit("]  "), "title", F.lit(" Section "), "section", F.lit(" "), "act", F.lit("\n        Document type: "), "document_type", F.lit("\n        Similarity: "), F.format_string("%.2f", "similarity"), F.lit('\n        Excerpt: "'), "excerpt", F.lit('"'))
    listed = shown.groupBy("response_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", entry.alias("t")))), lambda x: x["t"]), "\n\n").alias("sources"))
    rows = comparison(shown, None).groupBy("response_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" | ", "point", "ipc", "bns"))), "\n").alias("table"))
    score = confidence(shown.withColumnRenamed("number", "rank"))
    whole = queries.join(listed, "response_id", "left").join(rows, "response_id", "left").join(score, "response_id", "left")
    text = F.concat(F.lit("Research report, "), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" sources: "), "query", F.lit("\n\n"), F.coalesce("table", F.lit("No relevant sources found for this query.")), F.lit("\n\n"), F.coalesce("sources", F.lit("")), F.lit("\n\nAnswer confidence: "), F.coalesce(F.col("confidence"), F.lit(0)).cast("string"), F.lit("%"))
    return whole.select("response_id", text.alias("report"))


def refusal(topic: Column, templates) -> Column:
    """An answer for a topic without sources; which one, its hash decides."""
    options = F.array(*[F.replace(F.lit(t), F.lit("{topic}"), topic) for t in templates])
    return F.element_at(options, (F.pmod(F.xxhash64(topic), F.lit(len(templates))) + 1).cast("int"))


def first_hits(results: DataFrame, k: int) -> DataFrame:
    return results.where(F.col("rank") <= k)


def side_by_side(requested: DataFrame, counterpart: DataFrame) -> DataFrame:
    """Hits of the section asked for and of its counterpart by rank."""
    left = requested.select("query_id", "rank", F.col("id").alias("requested"))
    return left.join(counterpart.select("query_id", "rank", F.col("id").alias("counterpart")), ["query_id", "rank"], "full_outer")


def timings(stages: DataFrame) -> DataFrame:
    """(query_id, total_ms, slowest) of (query_id, stage, ms)."""
    return stages.groupBy("query_id").agg(F.round(F.sum("ms"), 1).alias("total_ms"), F.max_by("stage", F.struct("ms", "stage")).alias("slowest"))


def top_of_act(results: DataFrame, order: dict[str, int]) -> DataFrame:
    """Results by the priority of their acts, then by rank; acts without one come last."""
    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), "act"), F.lit(len(order) + 1))
    return results.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(priority, "rank")))


def hits(results: DataFrame) -> DataFrame:
    """Results as they are handed out: scores between 0 and 1, a snippet, reasons."""
    shown = lambda c: T.display_score(F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    scores = [c for c in ("reranker_score", "hybrid_score", "rrf_score", "boost_score", "semantic_score", "bm25_score") if c in results.columns]
    return results.select("query_id", "rank", F.col("id").cast("string").alias("id"), "score", *[shown(c) for c in scores], "act", F.struct("section", F.col("page").cast("string").alias("page"), "source").alias("citation"), "reasons", T.snippet("document").alias("snippet"))


def enriched(found: DataFrame, fetched: DataFrame, key: str = "doc") -> DataFrame:
    """Search results with the documents that could be fetched; the others are left out."""
    return found.join(fetched.where("status = 'success'").drop("status"), key)
