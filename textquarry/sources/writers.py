"""Sinks and maintenance: append, upsert, delete, reindex, versions, bundles, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def without_nulls(m) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def scalar_list(c, sort: bool = False) -> Column:
    """A list as one text; sort: for sets, whose order means nothing."""
    values = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(values) if sort else values, ", ")


def new_rows(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet, the first of each key."""
    return incoming.join(stored.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def upserted(stored: DataFrame, incoming: DataFrame, key: str, newest: str) -> DataFrame:
    """The newest row of each key of both; rows of equal age: the incoming one."""
    both = stored.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(newest), F.desc("_in")))).where("_n = 1").drop("_n", "_in")


def deleted(stored: DataFrame, where: Column) -> DataFrame:
    return stored.where(~F.coalesce(where, F.lit(False)))


def changed_since(files: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Files whose modification time is within the last days: what an incremental reindex reads."""
    return files.where(F.col("modificationTime") >= F.expr(f"timestamp '{as_of}' - interval {days} days"))


def reindex_due(last: Column, as_of: Column, every_days: int) -> Column:
    return last.isNull() | (F.datediff(as_of, last) >= every_days)


def save_version(df: DataFrame, path: str, version: str, created_at: str) -> None:
    """A snapshot under its own folder, and a line in the manifest."""
    df.write.mode("errorifexists").parquet(f"{path}/versions/{version}")
    stats = df.agg(F.count("*").alias("n_rows")).select(F.lit(version).alias("version"), F.lit(created_at).alias("created_at"), "n_rows")
    stats.write.mode("append").json(f"{path}/manifest")


def versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version string, created_at string, n_rows long").json(f"{path}/manifest").orderBy(F.desc("created_at"), F.desc("version"))


def at_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The rows of a version, the newest if none is named: going back is reading another folder."""
    if version is None:
        version = versions(spark, path).first()["version"]
    return spark.read.parquet(f"{path}/versions/{version}")


def pending(files: DataFrame, done: DataFrame, key: str = "source") -> DataFrame:
    """Files that no checkpoint names: where an interrupted ingestion goes on."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def write_bundle(df: DataFrame, path: str, by: str, text_col: str) -> None:
    """An offline bundle: rows partitioned by act, and a manifest of counts, size and checksum."""
    df.write.partitionBy(by).parquet(f"{path}/rows")
    by_act = df.groupBy(F.coalesce(F.col(by), F.lit("")).alias("act")).agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("size"), F.sum(F.xxhash64(text_col).cast("decimal(38,0)")).alias("x"))
    by_act.agg(F.sum("n").alias("rows"), F.sum("size").alias("bytes"), F.array_sort(F.collect_list("act")).alias("acts"), F.sha2(F.sum("x").cast("string"), 256).substr(1, 16).alias("checksum")).write.json(f"{path}/manifest")


def export_rows(results: DataFrame) -> DataFrame:
    """Batch results as flat rows for JSON or CSV."""
    return results.select("query_id", "query", "rank", "id", F.round("score", 3).alias("score"), T.snippet("document").alias("snippet"))


def cited_acts(citations: DataFrame, sources: DataFrame, least: float = 0.70) -> DataFrame:
    """Citations of acts that a source of enough similarity has: a semi join on the upper-case act."""
    acts = sources.where(F.col("similarity") >= least).select(F.upper("act").alias("_act")).distinct()
    return citations.join(acts, F.upper("act") == F.col("_act"), "left_semi")


def prometheus(metrics: DataFrame) -> DataFrame:
    """(line) of metrics(name, labels map, value) in the text format of Prometheus."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.when(labels != "", F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))
