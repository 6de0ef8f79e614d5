"""Keys that are stored already: a store in buckets, with Bloom filters that tell which buckets an append must read.

A key's hash gives its bucket. Each append writes one generation: its new keys by bucket, and for each bucket a Bloom filter of them (`BITS` bits and `PROBES`
probes a key, so one unknown key in a hundred passes). A later append tests its keys against the filters of their buckets, block by block (`BLOCK` keys), and reads only the
buckets in which some key passed; keys that no filter knows are new without any reading. The state, written last, names what generations count.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store

BITS, PROBES = 10, 7
BLOCK = 1 << 20
BUCKETS = 64


def _bits(h: np.ndarray, m: int) -> np.ndarray:
    """The PROBES bits of each 64-bit hash in a filter of m bits: double hashing of its halves."""
    h = h.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(m)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    m = max(64, -(-len(hashes) * BITS // 8) * 8)
    flags = np.zeros(m, bool)
    flags[_bits(hashes, m).ravel()] = True
    return np.packbits(flags).tobytes()


def passes(hashes: np.ndarray, filters: list[bytes]) -> np.ndarray:
    """Which hashes some filter may know: all that it does, and few others."""
    out = np.zeros(len(hashes), bool)
    for f in filters:
        flags = np.unpackbits(np.frombuffer(f, np.uint8)).astype(bool)
        out |= flags[_bits(hashes, len(flags))].all(axis=1)
    return out


class KeyStore:
    """Distinct keys (text) in a folder; null is no key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.state = store.read_state(spark, f"{folder}/state") or {"generations": []}

    @staticmethod
    def _hashed(keys: DataFrame) -> DataFrame:
        h = F.xxhash64("key")
        return keys.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftright(h, 48), F.lit(BUCKETS)).cast("int"))

    def keys(self) -> DataFrame:
        """All keys, with bucket."""
        paths = [f"{self.folder}/{g}/keys" for g in self.state["generations"]]
        rows = [self.spark.read.schema("key string, bucket int").option("basePath", p).parquet(p) for p in paths]
        out = self.spark.createDataFrame([], "key string, bucket int")
        for r in rows:
            out = out.unionByName(r)
        return out

    def _maybe_known(self, hashed: DataFrame) -> DataFrame:
        """hashed(key, h, bucket) that a filter of their bucket lets pass."""
        blooms = self.spark.read.parquet(*[f"{self.folder}/{g}/blooms" for g in self.state["generations"]])
        salts = F.ceil(F.count("*") / BLOCK).cast("int")
        blocks = store.saved(hashed.groupBy("bucket").agg(salts.alias("salts")))  # a row for each bucket
        left = hashed.join(blocks, "bucket").withColumn("salt", F.pmod(F.hash("h"), F.col("salts"))).drop("salts")
        right = blooms.join(blocks, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

        def tested(keys: pa.Table, filters: pa.Table) -> pa.Table:
            ok = passes(keys["h"].to_numpy(), filters["bloom"].to_pylist())
            return keys.select(["key", "bucket"]).filter(pa.array(ok))

        return left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(tested, "key string, bucket int")

    def unknown(self, keys: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """The distinct keys of keys(key) that aren't stored, and a report: buckets and stored keys there are, and those read."""
        hashed = store.saved(self._hashed(keys.where("key IS NOT NULL").select("key").distinct()))
        if not self.state["generations"]:
            return hashed.select("key"), {"buckets": 0, "buckets_read": 0, "keys": 0, "keys_read": 0}
        maybe = store.saved(self._maybe_known(hashed))
        touched = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # BUCKETS at most
        stored = self.keys().where(F.col("bucket").isin(touched))
        sizes = self.spark.read.parquet(*[f"{self.folder}/{g}/blooms" for g in self.state["generations"]]).select("bucket", "n")
        total = sizes.agg(F.countDistinct("bucket").alias("buckets"), F.sum("n").alias("keys"), F.coalesce(F.sum(F.when(F.col("bucket").isin(touched), F.col("n"))), F.lit(0)).alias("read")).first()
        known = maybe.join(stored, ["bucket", "key"], "left_semi").select("key")
        return hashed.select("key").join(known, "key", "left_anti"), {"buckets": total["buckets"], "buckets_read": len(touched), "keys": total["keys"], "keys_read": total["read"]}

    def append(self, keys: DataFrame) -> dict[str, int]:
        """Stores the keys that aren't yet, as one generation; the report of the reading."""
        fresh, report = self.unknown(keys)
        fresh = store.saved(self._hashed(fresh))
        name = uuid.uuid4().hex

        def filtered(rows: pa.Table) -> pa.Table:
            h = rows["h"].to_numpy()
            return pa.table({"bucket": rows["bucket"].slice(0, 1), "n": pa.array([len(h)]), "bloom": pa.array([bloom(h)], pa.binary())})

        fresh.select("key", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}/keys")
        fresh.select("bucket", "h").groupBy("bucket").applyInArrow(filtered, "bucket int, n long, bloom binary").write.parquet(f"{self.folder}/{name}/blooms")
        self.state = {"generations": [*self.state["generations"], name]}
        store.write_state(self.spark, f"{self.folder}/state", self.state)
        return report
