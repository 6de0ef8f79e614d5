"""Citation graph: vertices (case_id, ...), edges (src, dst). Neighbours, k-hop search, rulings, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from . import scoring
from .retrieval import broadcast_if_few


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def neighbours(edges: DataFrame, vertices: DataFrame, direction: str = "out") -> DataFrame:
    """(case_id, neighbour) of known neighbours: cases it cites (out) or that cite it (in)."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    pairs = distinct_edges(edges).select(F.col(a).alias("case_id"), F.col(b).alias("neighbour"))
    return pairs.join(vertices.select(F.col("case_id").alias("neighbour")), "neighbour", "left_semi").select("case_id", "neighbour")


def within(edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """(start, node, distance) of nodes up to `hops` undirected steps away, start itself left out.

    One reading of the edges and one anti join a hop; a frontier of several starts is walked at once. Only edges at the frontier are told apart and
    shuffled: each meets it where it is read, and what passes from hop to hop is written, so that its rows are counted before any are broadcast.
    """
    edges = edges.select("src", "dst")
    seen = store.saved(start.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("distance")))
    frontier = seen
    for hop in range(1, hops + 1):
        at = broadcast_if_few(frontier.select("start", "node").distinct())
        step = reduce(DataFrame.union, [edges.join(at, edges[a] == at["node"]).select("start", F.col(b).alias("node")) for a, b in (("src", "dst"), ("dst", "src"))]).distinct()
        frontier = store.saved(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def degrees(edges: DataFrame) -> DataFrame:
    e = distinct_edges(edges)
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def ruled(vertices: DataFrame, rulings: DataFrame) -> DataFrame:
    """vertices with strength and status after rulings(case_id, ruled_by, kind): overruled cases keep 0.1; followed_in and overrules name the cases."""
    by_case = rulings.groupBy("case_id").agg(F.max(F.col("kind") == "overruled").alias("gone"), F.array_sort(F.collect_set(F.when(F.col("kind") == "followed", F.col("ruled_by")))).alias("followed_in"))
    back = rulings.where("kind = 'overruled'").groupBy(F.col("ruled_by").alias("case_id")).agg(F.array_sort(F.collect_set("case_id")).alias("overrules"))
    none = F.expr("cast(array() as array<string>)")
    gone = F.coalesce(F.col("gone"), F.lit(False))
    out = vertices.join(by_case, "case_id", "left").join(back, "case_id", "left")
    return out.select(
        *[F.col(c) for c in vertices.columns if c != "status"], F.when(gone, "overruled").otherwise(F.col("status")).alias("status"),
        F.round(F.when(gone, 0.1).otherwise(scoring.precedent_strength("bench_size", "court")), 6).alias("strength"), F.coalesce("followed_in", none).alias("followed_in"), F.coalesce("overrules", none).alias("overrules"),
    )


def statistics(ruled_cases: DataFrame, edges: DataFrame) -> DataFrame:
    """One row; edges count from known cases."""
    known = distinct_edges(edges).join(ruled_cases.select(F.col("case_id").alias("src")), "src", "left_semi").agg(F.count("*").alias("total_citations"))
    stats = ruled_cases.agg(F.count("*").alias("total_cases"), F.count_if(F.col("status") == "overruled").alias("overruled_cases"), F.count_if(F.size("followed_in") > 0).alias("followed_cases"), F.round(F.avg("strength"), 2).alias("average_strength"))
    return stats.crossJoin(F.broadcast(known))  # one row each


def chain(vertices: DataFrame, edges: DataFrame, case_id: str, direction: str = "both") -> DataFrame:
    """Known cases that a case cites (backward), that cite it (forward), or both; latest first, those without a date last."""
    parts = []
    if direction in ("both", "backward"):
        parts.append(neighbours(edges, vertices, "out").where(F.col("case_id") == case_id).select("neighbour", F.lit("cites").alias("relation")))
    if direction in ("both", "forward"):
        parts.append(neighbours(edges, vertices, "in").where(F.col("case_id") == case_id).select("neighbour", F.lit("cited_by").alias("relation")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.join(vertices.withColumnRenamed("case_id", "neighbour"), "neighbour").orderBy(F.col("decided").desc_nulls_last(), "neighbour")


def by_citation(vertices: DataFrame, citation: str) -> DataFrame:
    """The first case, by id, whose citation contains the text."""
    return vertices.where(F.contains(F.lower("citation"), F.lit(citation.lower()))).orderBy("case_id").limit(1)


def by_keyword(ruled_cases: DataFrame, keyword: str) -> DataFrame:
    k = F.lit(keyword.lower())
    hit = F.contains(F.lower("case_name"), k) | F.coalesce(F.contains(F.lower("ratio"), k), F.lit(False))
    return ruled_cases.where(hit).orderBy(F.desc("strength"), "case_id")


def with_status_mark(ruled_cases: DataFrame) -> DataFrame:
    mark = F.when(F.col("status") == "active", "✓").when(F.col("status") == "overruled", "✗").when(F.col("status") == "modified", "~").when(F.col("status") == "followed", "★").otherwise("?")
    followed = F.when(F.size("followed_in") > 0, F.concat(F.lit("(followed in "), F.size("followed_in").cast("string"), F.lit(" cases)")))
    return ruled_cases.select("case_id", F.concat_ws(" ", mark, "citation", followed, F.when(F.col("status") == "overruled", "(overruled)")).alias("label"))


def ratio_decidendi(c):
    """The principle a judgment states, by the first of five phrases, 500 characters at most."""
    phrases = (r"the\s+principle\s+laid\s+down\s+is", r"the\s+law\s+laid\s+down\s+is", r"holding\s+that", r"it\s+is\s+well\s+settled\s+that", r"the\s+ratio\s+decidendi\s+is")
    found = [F.nullif(F.regexp_extract(c, rf"(?is){p}[:\s]+(.+?)(?:\n\n|\.\s)", 1), F.lit("")) for p in phrases]
    return F.substring(F.trim(F.coalesce(*found)), 1, 500)
