"""An inverted-file index of vectors: cosine search that compares a query with the cells near it, filtered in the scan, exact on demand.

Build. Spherical k-means on a sample (at most `FIT_ROWS` rows, drawn by a hash of the id) gives the cells, one for each `ROWS_PER_CELL` rows and
`MAX_CELLS` at most; cells near each other form groups. Every row is stored once, with its cell and the filter columns, sorted by group and cell.
A table of cells has each one's centroid, number of rows and radius (the largest angle of a row to the centroid).

Search. A query probes cells from the nearest on, until they hold the share of all rows that gave `RECALL` on `CALIBRATED_ON` rows of the sample; the share is
known for several densities, as a filter thins the rows out and the k nearest lie further away. A query goes once to each group in which it has cells, and
meets the group's rows block by block (`BLOCK_ROWS` rows, `BLOCK_QUERIES` queries), so a cell that holds most rows, or one that most
queries probe, is spread over many tasks. What is compared is compared exactly, in double precision.

exact=True goes on: a cell is skipped only if no row in its radius can be nearer than the query's k-th so far; all others are read, so
the result is that of comparing all pairs.

Rows and queries whose vectors are null, zero, of another length than most, or hold null or non-finite numbers take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from .retrieval import broadcast_if_few

FIT_ROWS = 65_536
ROWS_PER_CELL, MAX_CELLS = 12, 4_096
ROUNDS = 8
RECALL, CALIBRATED_ON, NEIGHBOURS = 0.91, 200, 20
#: Shares of the rows that may pass a filter, for which shares to probe are measured.
DENSITIES = (1.0, 0.5, 0.25, 0.1, 0.03)
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024
SEED = 17


def _matrix(column, kind=np.float64) -> np.ndarray:
    """A list column without nulls as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(x.dtype).tiny)


def _nearest(x: np.ndarray, centroids: np.ndarray, block: int = 4_096) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[(x[i : i + block] @ centroids.T).argmax(1) for i in range(0, len(x), block)]])


def _clustered(x: np.ndarray, cells: int, seed: int = SEED) -> np.ndarray:
    """Unit centroids by spherical k-means; a cell that empties takes a row of the sample."""
    rng = np.random.RandomState(seed)
    centroids = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        of = _nearest(x, centroids)
        order = np.argsort(of, kind="stable")
        present, at = np.unique(of[order], return_index=True)
        fresh = x[rng.choice(len(x), cells, replace=False)].copy()
        fresh[present] = np.add.reduceat(x[order], at, axis=0)
        centroids = _unit(fresh).astype(x.dtype)
    return centroids


def usable(vectors: DataFrame, vector: str, length: int | None = None) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine if length is None else fine & (F.size(vector) == length), F.lit(False))


class VectorIndex:
    """The index in a folder, as `build` wrote it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.state = store.read_state(spark, f"{folder}/state")
        cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").toArrow()  # MAX_CELLS rows at most
        self.centroids, self.group_of, self.sizes, self.radii = _matrix(cells["centroid"]), cells["group"].to_numpy(), cells["n"].to_numpy(), cells["radius"].to_numpy()
        self.rows = spark.read.parquet(f"{folder}/rows")

    # --- build

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", filters: tuple[str, ...] = ()) -> VectorIndex:
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector_col).alias("vector"), *filters).where(usable(vectors, "vector"))
        length = (rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first() or {"length": 1})["length"]
        rows = rows.where(F.size("vector") == length)
        n = rows.count()
        drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < F.lit(min(1.0, 1.1 * FIT_ROWS / max(n, 1)) * (1 << 30))).select("vector").limit(FIT_ROWS)
        sample = _unit(_matrix(drawn.toArrow()["vector"]).astype(np.float32)).astype(np.float32)
        if not len(sample):
            sample = np.zeros((1, length), np.float32)
        cells = max(1, min(MAX_CELLS, n // ROWS_PER_CELL, len(sample)))
        centroids = _clustered(sample, cells)
        groups = math.ceil(math.sqrt(cells))
        group_of = _nearest(centroids, _clustered(centroids, groups, SEED + 1))

        def placed(batches):
            for batch in batches:
                x = _unit(_matrix(batch.column("vector")))
                cell = _nearest(x, centroids)
                angle = np.arccos(np.clip((x * centroids[cell]).sum(1), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(group_of[cell].astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cell", "group", "angle"])

        kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "cell int, group int, angle double"])
        dealt = rows.mapInArrow(placed, kinds).repartitionByRange("group", "cell", F.xxhash64("doc_id"))
        dealt.sortWithinPartitions("group", "cell").write.parquet(f"{folder}/rows")
        within = spark.read.parquet(f"{folder}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        table = spark.createDataFrame(pa.table({"cell": pa.array(range(cells), pa.int32()), "group": pa.array(group_of.astype(np.int32)), "centroid": pa.array(list(centroids.astype(np.float64)))}))
        table.join(within, "cell", "left").na.fill({"n": 0, "radius": 0.0}).coalesce(1).write.parquet(f"{folder}/cells")
        sizes = np.bincount(_nearest(sample, centroids), minlength=cells)
        shares = [cls._share(sample, centroids, sizes, d) for d in DENSITIES]
        store.write_state(spark, f"{folder}/state", {"n": n, "length": length, "shares": shares})
        return cls(spark, folder)

    @staticmethod
    def _share(sample: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, density: float) -> float:
        """The share of the rows to probe for RECALL, if a filter leaves that share of them."""
        rng = np.random.RandomState(SEED)
        pool = np.flatnonzero(rng.random_sample(len(sample)) < density)
        if len(pool) < 10 * NEIGHBOURS:
            return 1.0
        asked = rng.choice(len(sample), min(CALIBRATED_ON, len(sample)), replace=False)
        near = sample[asked] @ sample[pool].T
        near[pool[None, :] == asked[:, None]] = -2
        best = np.argpartition(-near, NEIGHBOURS, axis=1)[:, :NEIGHBOURS]
        order = np.argsort(-(sample[asked] @ centroids.T), axis=1)
        reached = np.empty_like(order, dtype=np.float64)  # the share of the rows probed once each cell is
        np.put_along_axis(reached, order, np.cumsum(sizes[order], axis=1) / sizes.sum(), axis=1)
        return float(min(1.0, np.quantile(np.take_along_axis(reached, _nearest(sample, centroids)[pool][best], axis=1), RECALL)))

    # --- search

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")).where(usable(queries, "vector", self.state["length"]))

    def _probes(self, asked: DataFrame, share: float) -> DataFrame:
        """(query_id, vector, group, cells) of the nearest cells that hold a share of the rows; a row for each group with some."""
        centroids, sizes = self.centroids, self.sizes

        def chosen(vectors: np.ndarray, _):
            order = np.argsort(-(vectors @ centroids.T), axis=1)
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            out = np.zeros(order.shape, bool)
            np.put_along_axis(out, order, before < share * sizes.sum(), axis=1)
            return out

        return self._cells_of(asked, chosen)

    def _reachable(self, asked: DataFrame, probed: float) -> DataFrame:
        """The same of the cells beyond that share which may hold a row nearer than `least`."""
        centroids, sizes, radii = self.centroids, self.sizes, self.radii

        def chosen(vectors: np.ndarray, batch):
            cos = np.clip(vectors @ centroids.T, -1, 1)
            order = np.argsort(-(vectors @ centroids.T), axis=1)
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            done = np.zeros(order.shape, bool)
            np.put_along_axis(done, order, before < probed * sizes.sum(), axis=1)
            nearest = np.cos(np.maximum(0, np.arccos(cos) - radii[None, :]))
            least = batch.column("least").to_numpy(zero_copy_only=False)
            return ~done & (nearest >= least[:, None] - 1e-9) & (sizes > 0)[None, :]

        return self._cells_of(asked, chosen)

    def _cells_of(self, asked: DataFrame, chosen) -> DataFrame:
        group_of = self.group_of
        by_group = np.argsort(group_of, kind="stable")

        def run(batches):
            for whole in batches:
                for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                    vectors = _unit(_matrix(batch.column("vector")))
                    q, c = np.nonzero(chosen(vectors, batch)[:, by_group])
                    cell = by_group[c]
                    group = group_of[cell]
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(group) != 0)])) if len(q) else np.zeros(0, np.int64)
                    cells = pa.ListArray.from_arrays(pa.array(np.append(new, len(q)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                    of = pa.array(q[new])
                    unit = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(of), unit.take(of), pa.array(group[new].astype(np.int32)), cells], names=["query_id", "vector", "group", "cells"])

        kind = asked.schema["query_id"].dataType.simpleString()
        return asked.mapInArrow(run, f"query_id {kind}, vector array<double>, group int, cells array<int>")

    def _compared(self, probes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, similarity, compared): the k best of each query in each block, and how many of its rows were compared."""
        probes = store.saved(probes)
        blocks = rows.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nv"))
        blocks = blocks.join(probes.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("nq")), "group")
        blocks = broadcast_if_few(store.saved(blocks))  # a row for each group: the square root of MAX_CELLS at most
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = rows.select("doc_id", "vector", "cell", "group").join(blocks, "group").withColumn("vb", F.pmod(F.xxhash64("doc_id"), F.col("nv")).cast("int")).withColumn("qb", each(F.col("nq"))).drop("nv", "nq")
        right = probes.join(blocks, "group").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).withColumn("vb", each(F.col("nv"))).drop("nv", "nq")

        def block(rows: pa.Table, asked: pa.Table) -> pa.Table:
            x, y = _unit(_matrix(rows["vector"])), _matrix(asked["vector"])
            lists = asked["cells"].combine_chunks()
            cell, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(asked)), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(cell, kind="stable")
            cell, of = cell[order], of[order]
            own = rows["cell"].to_numpy()
            by_cell = np.argsort(own, kind="stable")
            qs, ds, ss = [], [], []
            cells, starts = np.unique(own[by_cell], return_index=True)
            for c, lo, hi in zip(cells, starts, [*starts[1:], len(own)], strict=True):
                at = of[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]
                if len(at):
                    members = by_cell[lo:hi]
                    qs.append(np.repeat(at, len(members)))
                    ds.append(np.tile(members, len(at)))
                    ss.append((y[at] @ x[members].T).ravel())
            q, d, s = (np.concatenate(a) if a else np.zeros(0, t) for a, t in ((qs, np.int64), (ds, np.int64), (ss, np.float64)))
            ids = rows["doc_id"].to_numpy()[d]
            order = np.lexsort((ids, -np.round(s, 9), q))
            q, ids, s = q[order], ids[order], s[order]
            first = np.searchsorted(q, q)
            best = np.arange(len(q)) - first < k
            compared = np.bincount(q, minlength=len(asked))[q]
            return pa.table({"query_id": asked["query_id"].combine_chunks().take(pa.array(q[best])), "doc_id": pa.array(ids[best]), "similarity": pa.array(s[best]), "compared": pa.array(np.where(np.arange(len(q)) == first, compared, 0)[best])})

        key = ["group", "vb", "qb"]
        kind = probes.schema["query_id"].dataType.simpleString()
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(block, f"query_id {kind}, doc_id long, similarity double, compared long")

    def search(self, queries: DataFrame, k: int, where: Column | None = None, exact: bool = False, share: float | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, doc_id, similarity, rank) of the k nearest rows of each of queries(query_id, vector), and one row (compared, pairs): how many
        pairs of a query and a row were compared, and how many there are. where: a condition on the filter columns, in the scan. share: what to probe instead of the calibrated.
        """
        rows = self.rows if where is None else self.rows.where(where)
        n = self.state["n"] if where is None else rows.count()
        if share is None:
            density = n / max(1, self.state["n"])
            share = next((s for d, s in zip(DENSITIES, self.state["shares"], strict=True) if d <= density), 1.0)  # of the next sparser that was measured
        asked = self._asked(queries)
        best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "doc_id")))
        found = store.saved(self._compared(self._probes(asked, share), rows, k))
        if exact and share < 1:
            kth = best(found).where(F.col("rank") <= k).where(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))
            asked = asked.join(kth, "query_id", "left").na.fill({"least": -2.0})
            found = found.unionByName(store.saved(self._compared(self._reachable(asked, share), rows, k)))
        out = best(found).where(F.col("rank") <= k).select("query_id", "doc_id", "similarity", "rank")
        return out, found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared")).crossJoin(asked.agg((F.count("*") * F.lit(n)).alias("pairs")))  # one row each
