"""Sinks of streams that hold each batch once: running aggregates with a ledger of batches, and partitions overwritten where documents changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..sources import writers

#: How two values of a column become one.
MERGES = {"sum": F.sum, "max": F.max, "min": F.min}


class RunningTable:
    """Aggregates by key in a folder, to which batches are added, each once.

    Rows are dealt to buckets by a hash of the key. A batch is aggregated, merged with the present rows of the buckets it touches and written into a folder
    of its own; then one further line of state names the folder of each bucket and the number of the batch for its source (the ledger). So a batch that comes
    again after a failure is left out if the ledger has it, and written anew if the driver was lost before that; buckets that no key of it falls into keep their
    files. A source's batch numbers rise, as those of a stream with one checkpoint do. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], merges: dict[str, str], schema: str, buckets: int = 16):
        self.spark, self.folder, self.key, self.merges, self.schema, self.buckets = spark, folder, key, merges, schema, buckets

    def _state(self) -> dict:
        return store.read_state(self.spark, f"{self.folder}/state") or {"applied": {}, "buckets": {}}

    def _merged(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*[MERGES[how](c).alias(c) for c, how in self.merges.items()])

    def apply(self, batch: DataFrame, number: int, source: str = "stream") -> bool:
        """Adds a batch of rows (key and merged columns); False if the ledger has it already."""
        state = self._state()
        if number <= state["applied"].get(source, -1):
            return False
        delta = store.saved(self._merged(batch, self.key).withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")))
        touched = [str(r["bucket"]) for r in delta.select("bucket").distinct().collect()]  # `buckets` rows at most
        if touched:
            present = self._read(state, touched)
            rows = delta.unionByName(present) if present is not None else delta
            path = f"{self.folder}/batches/{uuid.uuid4().hex}"
            self._merged(rows, ["bucket", *self.key]).repartition("bucket").write.partitionBy("bucket").parquet(path)
            state["buckets"] |= {b: f"{path}/bucket={b}" for b in touched}
        state["applied"][source] = number
        store.write_state(self.spark, f"{self.folder}/state", state)
        return True

    def _read(self, state: dict, buckets: list[str]) -> DataFrame | None:
        paths = {b: state["buckets"][b] for b in buckets if b in state["buckets"]}
        if not paths:
            return None
        rows = self.spark.read.schema(self.schema).parquet(*paths.values())
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def table(self) -> DataFrame:
        rows = self._read(state := self._state(), list(state["buckets"]))
        return self.spark.createDataFrame([], self.schema) if rows is None else rows.drop("bucket")

    def sink(self, stream: DataFrame, checkpoint: str, source: str = "stream", prepared: Callable[[DataFrame], DataFrame] = lambda df: df):
        """The writer of a stream into this table, to be started."""
        return stream.writeStream.foreachBatch(lambda df, number: self.apply(prepared(df), number, source) and None).option("checkpointLocation", checkpoint)


def reindexer(stream: DataFrame, target: str, checkpoint: str, by: str, key: str, newest: str, indexed: Callable[[DataFrame], DataFrame] = lambda df: df, gone: Column | None = None):
    """The writer of a stream of documents into an index table partitioned by `by`, to be started with availableNow.

    Each batch is indexed and merged by key, the newest row of a key winning, with the partitions that it falls into (nothing else is read), and these alone are
    overwritten; all other partitions keep their files. gone: rows that take their key out. A key stays in its partition. The checkpoint remembers what files were
    read; a batch that comes again after a failure makes the same rows, as merging it twice changes nothing.
    """

    def merged(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = store.saved(indexed(df))
        touched = fresh.select(by).distinct()
        present = _present(spark, target)
        if present is not None:
            present = present.join(touched, present[by].eqNullSafe(touched[by]), "left_semi").select(*[c for c in fresh.columns if c in present.columns])
            fresh = store.saved(writers.upserted(present, fresh, key, newest))
        else:
            fresh = writers.upserted(fresh.limit(0), fresh, key, newest)
        rows = fresh if gone is None else fresh.where(~F.coalesce(gone, F.lit(False)))
        rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(target)

    return stream.writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint)


def _present(spark: SparkSession, target: str) -> DataFrame | None:
    path, fs = store._path(spark, target)
    return spark.read.parquet(target) if fs.exists(path) and any(s.isDirectory() for s in fs.listStatus(path)) else None
