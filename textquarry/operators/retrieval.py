"""Ranked retrieval for batches of queries: BM25, exact dense search, fusion, filters with relaxation.

All operators take queries as a table: a single query is a table of one row. Ties are broken by id, ascending.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .. import store
from ..functions import text as T

K1, B, RRF_K = 1.5, 0.75, 60


def query_terms(queries: DataFrame, text_col: str = "query") -> DataFrame:
    """(query_id, term, qtf): query tokens with how often they occur; repeats count in BM25."""
    return queries.select("query_id", F.explode(T.tokens(text_col)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


#: Rows up to which a query-side table is broadcast; a larger one is joined by shuffle.
FEW_ROWS = 100_000


def broadcast_if_few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows: counted, not guessed, and no further than needed."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bm25(terms: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term with a query; statistics are those of docs.

    Texts are read and cut into tokens once, and written: statistics, frequencies and weights all come from there. Tokens that no query has are
    dropped where they are read, before anything is counted or shuffled.
    """
    tokened = store.saved(docs.select(F.col(id_col).alias("doc_id"), T.tokens(text_col).alias("tokens")).withColumn("dl", F.size("tokens")))
    stats = tokened.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    wanted = broadcast_if_few(terms.select("term").distinct())
    rows = tokened.select("doc_id", "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    posted = store.saved(rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl")))
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    return bm25_of_postings(terms, posted, df, stats, k1, b)


def bm25_of_postings(terms: DataFrame, posted: DataFrame, df: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """The same from a stored index: postings(doc_id, term, tf, dl), frequencies(term, df) and statistics(n, avgdl)."""
    few = broadcast_if_few(terms)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))))
    # one frequency for each query term, one row of statistics
    weighted = few.join(df, "term").crossJoin(F.broadcast(stats))
    scored = posted.join(F.broadcast(weighted) if few is not terms else weighted, "term").select("query_id", "doc_id", (weight * F.col("qtf")).alias("w"))
    return scored.groupBy("query_id", "doc_id").agg(F.sum("w").alias("score")).where("score > 0")


def ranked(scored: DataFrame, k: int | None = None, score: str = "score", key: str = "doc_id", digits: int | None = 9) -> DataFrame:
    """scored with rank within each query, best first; sums are compared to `digits` places so their order is stable. k: keep the first k."""
    by = F.round(score, digits) if digits is not None else F.col(score)
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by.desc(), key)))
    return out if k is None else out.where(F.col("rank") <= k)


def min_max(scored: DataFrame, score: str = "score") -> DataFrame:
    """Adds normalized_score: the score between the query's lowest and highest, 1 if they are equal. One row a query is joined back: no query's hits meet in one task."""
    bounds = scored.groupBy("query_id").agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    return scored.join(bounds, "query_id").withColumn("normalized_score", F.when(high <= low, 1.0).otherwise(T.clamp((F.col(score) - low) / (high - low)))).drop("_low", "_high")


#: Queries that a task holds at once, with the best of each; rows compared with them at once.
QUERY_BLOCK, ROW_BLOCK = 8192, 256


def dense(queries: DataFrame, vectors: DataFrame, k: int | None, epsilon: float = 0.0, id_col: str = "vec_id", where: Column | None = None) -> DataFrame:
    """(query_id, doc_id, similarity, rank): exact cosine search of queries(query_id, vector) over vectors, filtered first if asked.

    With k, every query of a block meets every row of a part by products of matrices, and a task keeps the best of each query: a row for each is all that goes on.
    Vectors that are null, hold null or non-finite components, have another length than most or are too long or short for single precision are compared one by one.
    """
    pool = vectors if where is None else vectors.where(where)
    pool = pool.select(F.col(id_col).alias("doc_id"), "embedding")
    pairs = lambda rows, asked: rows.crossJoin(asked).select("query_id", "doc_id", T.cosine(F.col("embedding"), F.col("vector"), epsilon).alias("similarity"))
    whole = all(isinstance(df.schema[c].dataType, IntegralType) for c, df in (("query_id", queries), ("doc_id", pool)))
    if k is None or not whole:  # every pair is asked for, or ids are texts
        return ranked(pairs(pool, broadcast_if_few(queries, 10_000)), k, "similarity")
    counted = queries.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).collect()  # a row for each length
    n, size = sum(r["n"] for r in counted), max([counted[0]["size"] if counted else 0, 1])

    def sound(vector: str) -> Column:
        lengthy = F.sqrt(T.dot(F.col(vector), F.col(vector)))
        return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & lengthy.between(1e-15, 1e15), F.lit(False))

    single = lambda v: F.transform(v, lambda x: x.cast("double"))
    blocks = max(1, -(-n // QUERY_BLOCK))
    # some parts for each task; many would send each query's best often
    parts = max(1, -(-3 * pool.sparkSession.sparkContext.defaultParallelism // blocks))
    asked = queries.where(sound("vector")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "block", F.lit(0).alias("kind"), F.col("query_id").cast("long").alias("id"), single("vector").alias("v"))
    rows = pool.where(sound("embedding")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    rows = rows.select("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("doc_id").cast("long").alias("id"), single("embedding").alias("v"))
    met = asked.unionByName(rows).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(_nearest(k, size, epsilon), "query_id long, doc_id long, similarity double")
    kinds = [F.col(c).cast(df.schema[c].dataType).alias(c) for c, df in (("query_id", queries), ("doc_id", pool))]
    met = met.select(*kinds, "similarity")
    odd_rows, odd_queries = pool.where(~sound("embedding")), queries.where(~sound("vector"))
    if not odd_rows.isEmpty():
        met = met.unionByName(pairs(odd_rows, queries))
    if not odd_queries.isEmpty():
        met = met.unionByName(pairs(pool.where(sound("embedding")), odd_queries))
    return ranked(met, k, "similarity")


def _nearest(k: int, size: int, epsilon: float):
    """Rows sorted by block, part and kind, queries first, to each query's best rows of the part: the k best, and those that rounding ties with the last."""

    def run(batches):
        key, held, block = None, [], None
        for batch in batches:
            where = batch.column("block").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy().astype(np.int64)
            kind, ids = batch.column("kind").to_numpy(), batch.column("id").to_numpy()
            vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if batch.num_rows else []
            for s, e in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                if where[s] != key:
                    if block is not None:
                        yield block.best()
                    key, held, block = where[s], [], None
                m = s + int((kind[s:e] == 0).sum())
                if m > s:
                    held.append((ids[s:m].copy(), vectors[s:m].copy()))
                if m < e and held:
                    block = block or _Block(*(np.concatenate(x) for x in zip(*held, strict=True)), k, epsilon)
                    for lo in range(m, e, ROW_BLOCK):
                        block.meet(ids[lo : min(e, lo + ROW_BLOCK)], vectors[lo : min(e, lo + ROW_BLOCK)])
        if block is not None:
            yield block.best()

    return run


class _Block:
    """A block of queries and the best rows that they have met."""

    #: What single precision and the rounding of ranks to 9 places may differ by.
    SLACK = 1e-5

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, epsilon: float):
        self.ids, self.vectors, self.k, self.epsilon = ids, vectors, k, epsilon
        self.lengths = _lengths(vectors)
        self.unit = (vectors / self.lengths[:, None]).astype(np.float32)
        self.least = np.full(len(ids), -np.inf, np.float32)
        self.held: list[tuple] = []
        self.size = 0

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        lengths = _lengths(vectors)
        near = self.unit @ (vectors / lengths[:, None]).astype(np.float32).T
        if self.epsilon:  # epsilon is added to the product of both lengths
            both = self.lengths[:, None] * lengths
            near *= (both / (both + self.epsilon)).astype(np.float32)
        of, at = np.nonzero(near >= self.least[:, None])
        for lo in range(0, len(of), 1 << 15):
            o, r = of[lo : lo + (1 << 15)].astype(np.int32), at[lo : lo + (1 << 15)]
            self.held.append((o, ids[r], _dot(self.vectors[o], vectors[r]) / (self.lengths[o] * lengths[r] + self.epsilon)))
        self.size += len(of)
        if self.size > 4 * self.k * len(self.ids):
            self._drop()

    def _drop(self) -> None:
        """Leaves each query's k best and what is as near as the last of them but for rounding, of equal values the k smallest ids: Spark ranks them."""
        of, ids, near = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -near, of))
        of, ids, near = of[order], ids[order], near[order]
        first = np.searchsorted(of, np.arange(len(self.ids)))
        full = np.flatnonzero(np.diff(np.append(first, len(of))) >= self.k)
        last = np.full(len(self.ids), -np.inf)
        last[full] = near[first[full] + self.k - 1]
        self.least = (last - self.SLACK).astype(np.float32)
        new = np.flatnonzero(np.concatenate(([True], (np.diff(of) != 0) | (np.diff(near) != 0))))
        nth = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
        on = (near >= last[of] - 2e-9) & (nth < self.k)
        self.held, self.size = [(of[on], ids[on], near[on])], int(on.sum())

    def best(self) -> pa.RecordBatch:
        if self.held:
            self._drop()
        of, ids, near = self.held[0] if self.held else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[of]), pa.array(ids), pa.array(near)], names=["query_id", "doc_id", "similarity"])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components as `functions.text.dot` does, so that the last bits agree."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(_dot(vectors, vectors))


def fused(semantic: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, rrf_score, semantic_rank, bm25_rank, similarity, bm25_score): reciprocal-rank fusion of documents in either list.

    One aggregation brings both lists together; similarity and normalized_score come along if the lists have them.
    """
    value = lambda df, c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    both = semantic.select("query_id", "doc_id", F.col("rank").alias("semantic_rank"), F.lit(None).cast("int").alias("bm25_rank"), value(semantic, "similarity").alias("similarity"), F.lit(None).cast("double").alias("bm25_score")).unionByName(
        lexical.select("query_id", "doc_id", F.lit(None).cast("int").alias("semantic_rank"), F.col("rank").alias("bm25_rank"), F.lit(None).cast("double").alias("similarity"), value(lexical, "normalized_score").alias("bm25_score"))
    )
    out = both.groupBy("query_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("semantic_rank", "bm25_rank", "similarity", "bm25_score")])
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    return out.withColumn("rrf_score", part("semantic_rank") + part("bm25_rank"))


def semantic_score(inverted: bool = False) -> Column:
    """The similarity as a share of the query's highest; inverted: 1 less that, as the original has it."""
    share = T.clamp(F.col("similarity") / F.greatest(F.max("similarity").over(Window.partitionBy("query_id")), F.lit(1e-9)))
    return F.coalesce(1 - share if inverted else share, F.lit(0.0))


def relaxed(candidates: DataFrame, strict: Column, loose: Column) -> DataFrame:
    """candidates(query_id, ...) with tier: those that pass the strict filter if the query has any, else the loose one, else all."""
    tiered = candidates.withColumn("tier", F.when(strict, 1).when(loose, 2).otherwise(3))
    best = tiered.groupBy("query_id").agg(F.min("tier").alias("_best"))  # joined back: no query's candidates meet in one task
    return tiered.join(broadcast_if_few(best), "query_id").where("tier <= _best").drop("_best")


def first_occurrences(results: DataFrame, key: Column, order: str = "rank") -> DataFrame:
    """The first row in rank order of each key within each query."""
    return results.withColumn("_key", key).withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(order))).where("_nth = 1").drop("_key", "_nth")


def one_per_group_first(results: DataFrame, group: str, wanted: Column, limit: int) -> DataFrame:
    """The first result of each wanted group comes first, groups in order; the rest follow by rank; cut at limit. Adds position."""
    nth = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))
    marked = results.withColumn("_lead", wanted & (nth == 1))
    order = [F.desc("_lead"), F.when(F.col("_lead"), F.col(group)), "rank"]
    out = marked.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out.where(F.col("position") <= limit).drop("_lead")


def page_of(results: DataFrame, page: int, size: int) -> DataFrame:
    """The rows of one page by rank, with total_pages (at least 1)."""
    total = results.groupBy("query_id").agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias("total_pages"))
    return results.where(F.col("rank").between((page - 1) * size + 1, page * size)).join(broadcast_if_few(total), "query_id")


def window_and_pool(page: int, size: int) -> tuple[int, int]:
    """How many results are retrieved for a page, and how many candidates for them."""
    window = max(25, page * size)
    return window, max(40, 2 * window)
