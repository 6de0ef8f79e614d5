"""Retrieval and answer metrics, run comparison, category roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LEGAL_TERMS = ("section", "act", "court", "punishment", "IPC", "BNS")


def retrieval_score(chunks: Column, keywords: Column, category: Column) -> Column:
    """0 to 100: keywords found (all of their words: half) in the texts; for irrelevant queries, how few texts have a legal term.

    Terms in capitals never occur in lower-cased texts; the original has them so.
    """
    text = F.lower(F.array_join(chunks, " "))
    found = F.aggregate(keywords, F.lit(0.0), lambda acc, k: acc + F.when(F.contains(text, F.lower(k)), 1.0).when(F.forall(F.filter(F.split(F.lower(k), r"\s+"), lambda w: w != ""), lambda w: F.contains(text, w)), 0.5).otherwise(0.0))
    relevant = F.least(F.lit(100), F.floor(found / F.greatest(F.size(keywords), F.lit(1)) * 100))
    legal = F.size(F.filter(chunks, lambda c: F.exists(F.array(*map(F.lit, LEGAL_TERMS)), lambda t: F.contains(F.lower(c), t))))
    return F.when(category == "irrelevant", F.when(legal == 0, 100).when(legal <= 2, 70).otherwise(30)).otherwise(relevant).cast("int")


def irrelevant_composite(no_sources: Column, routed_away: Column, no_legal_terms: Column) -> Column:
    return F.lit(0.5) * no_sources.cast("int") + F.lit(0.3) * routed_away.cast("int") + F.lit(0.2) * no_legal_terms.cast("int")


def context_metrics(rows: DataFrame) -> DataFrame:
    """rows(..., answer, contexts array, ground_truth) with context_precision, context_recall, answer_relevance, faithfulness."""
    truth = F.transform(T.sentences("ground_truth"), F.lower)
    long = F.filter(truth, lambda s: F.length(s) > 10)
    n = F.size("contexts")
    hits = F.size(F.filter("contexts", lambda c: F.exists(long, lambda s: F.contains(F.lower(c), s))))
    whole = F.lower(F.array_join("contexts", " "))
    found = F.size(F.filter(long, lambda s: F.contains(whole, s)))
    wanted, said = F.array_distinct(T.keywords("ground_truth")), F.array_distinct(T.keywords("answer"))
    share = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    return rows.select(
        "*", share(hits, n).alias("context_precision"), share(found, F.size(truth)).alias("context_recall"), share(F.size(F.array_intersect(wanted, said)), F.size(wanted)).alias("answer_relevance"),
        F.when(n > 0, share(F.size(F.filter(said, lambda w: F.contains(whole, w))), F.size(said))).otherwise(0.0).alias("faithfulness"),
    )


def recall_of(expected: Column, found: Column) -> Column:
    """The share of expected values that are found; 1.0 if none are expected."""
    hits = F.size(F.filter(expected, lambda x: F.array_contains(found, x)))
    return F.when(F.size(expected) > 0, hits / F.size(expected)).otherwise(1.0)


def by_category(scores: DataFrame, category: str, score: str) -> DataFrame:
    """(category, mean, n) of each category and of all (`overall`), in one pass."""
    out = scores.rollup(category).agg(F.avg(score).alias("mean"), F.count("*").alias("n"), F.grouping(category).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "overall").otherwise(F.col(category)).alias("category"), F.round("mean", 6).alias("mean"), "n")


def compared(runs: DataFrame, base: str, new: str) -> DataFrame:
    """(metric, base, new, delta, percent, verdict) of metrics both runs have."""
    a = runs.where(F.col("run") == base).select("metric", F.col("value").alias("base"), "higher_is_better")
    b = runs.where(F.col("run") == new).select("metric", F.col("value").alias("new"))
    delta = F.col("new") - F.col("base")
    better = F.when(F.col("higher_is_better"), delta).otherwise(-delta)
    return a.join(b, "metric").select(
        "metric", "base", "new", F.round(delta, 6).alias("delta"), F.round(delta / F.nullif("base", F.lit(0.0)) * 100, 2).alias("percent"), F.when(better > 0, "improved").when(better < 0, "regressed").otherwise("unchanged").alias("verdict")
    )


def best_setting(sweep: DataFrame, score: str) -> DataFrame:
    """The row of the highest score, ties to the smaller setting."""
    return sweep.orderBy(F.desc(score), *[c for c in sweep.columns if c != score]).limit(1)


def markdown(rows: DataFrame, order: str) -> DataFrame:
    """(line) of a table in markdown, rows in order; the header has the smallest key."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    return rows.select(F.col(order).cast("string").alias("key"), cells.alias("line"))
