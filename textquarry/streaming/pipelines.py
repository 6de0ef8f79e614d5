"""Streaming queries: time buckets, running patterns, incremental ingestion, alerts, audit sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, time: str, size: str, late: str, by: list[str] = ()) -> DataFrame:
    """Counts by window; rows later than the watermark are dropped, so state is bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *by).agg(F.count("*").alias("count"))


def running_patterns(log: DataFrame) -> DataFrame:
    """(query, count, avg_ms, last_seen), for update mode."""
    return log.groupBy("query").agg(F.count("*").alias("count"), F.avg("response_ms").alias("avg_ms"), F.max("created_at").alias("last_seen"))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))


def new_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Each file once, as it arrives; the checkpoint remembers which were read."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(path)


def alerts(amendments: DataFrame, rules: DataFrame) -> DataFrame:
    """Amendments (a stream or a batch) with each rule of their act: a stream-static join."""
    return amendments.join(rules, "act_name")


def deduplicated(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def audit_sink(events: DataFrame, path: str, checkpoint: str):
    """Audit events as JSON lines in a folder for each day; returns the writer, to be started."""
    dated = events.withColumn("day", F.to_date(F.timestamp_seconds("timestamp")))
    return dated.writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)


def emitted(results: DataFrame) -> DataFrame:
    """(query_id, seq, event, payload): what a client is told of a search: route, summary, each result, complete."""
    answers = results.groupBy("query_id", "route").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("hits"))
    step = lambda kind, payload: F.struct(F.lit(kind).alias("event"), payload.alias("payload"))
    events = F.concat(
        F.array(step("route", F.col("route")), step("summary", F.concat(F.size("hits").cast("string"), F.lit(" results")))),
        F.transform("hits", lambda h: step("result", h["id"])),
        F.array(step("complete", F.lit(""))),
    )
    return answers.select("query_id", F.posexplode(events).alias("seq", "e")).select("query_id", "seq", "e.event", "e.payload")
