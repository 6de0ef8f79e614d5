"""Usage analytics over a search log (query, route, confidence, result_count, response_ms, cache_hit, created_at), and the query cache.

Every look-back takes `as_of` in epoch seconds instead of the clock, so results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order

DAY = 86400


def epoch(c) -> Column:
    """Epoch seconds of a timestamp with or without zone, read as UTC."""
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def since(log: DataFrame, as_of: float | None, days: int) -> DataFrame:
    return log if as_of is None else log.where(F.col("created_at") > as_of - days * DAY)


def overview(log: DataFrame, as_of: float | None = None, days: int = 30) -> DataFrame:
    """One row in one pass: queries, mean response, share of cache hits."""
    rate = F.coalesce(F.round(F.count_if("cache_hit") / F.nullif(F.count("*"), F.lit(0)) * 100, 1), F.lit(0.0))
    return since(log, as_of, days).agg(F.count("*").alias("total_queries"), F.coalesce(F.round(F.avg("response_ms"), 1), F.lit(0.0)).alias("avg_response_ms"), rate.alias("cache_hit_rate"))


def patterns(log: DataFrame, poison: bool = False) -> DataFrame:
    """(query, count, avg_ms, last_seen) of each query. poison: one missing time makes a mean missing, as a running mean does."""
    mean = F.avg("response_ms")
    return log.groupBy("query").agg(F.count("*").alias("count"), (F.when(F.count("response_ms") == F.count("*"), mean) if poison else mean).alias("avg_ms"), F.max("created_at").alias("last_seen"))


def popular(log: DataFrame, limit: int = 10, as_of: float | None = None, days: int = 30) -> DataFrame:
    found = since(patterns(log).withColumnRenamed("last_seen", "created_at"), as_of, days)
    return found.orderBy(F.desc("count"), "query").limit(limit).select("query", "count", F.coalesce(F.round("avg_ms", 1), F.lit(0.0)).alias("avg_ms"))


def domains(log: DataFrame, as_of: float | None = None, days: int = 30) -> DataFrame:
    """(route, count, percent). The total is over the routes, of which there are few."""
    counts = since(log, as_of, days).where("route IS NOT NULL").groupBy("route").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("route", "count", F.round(F.col("count") / F.col("total") * 100, 1).alias("percent"))


def hourly(log: DataFrame, as_of: float | None = None, days: int = 7) -> DataFrame:
    return since(log, as_of, days).groupBy(F.floor(F.col("created_at") / 3600).alias("hour")).agg(F.count("*").alias("count"))


def confidence_bands(log: DataFrame, as_of: float | None = None, days: int = 30) -> DataFrame:
    c = F.col("confidence")
    band = F.when(c >= 75, "high").when(c >= 50, "medium").when(c >= 25, "low").otherwise("very_low")
    return since(log, as_of, days).where("confidence IS NOT NULL").groupBy(band.alias("level")).agg(F.count("*").alias("count"))


def trend(log: DataFrame, as_of: float | None = None, days: int = 7, hours: int = 6) -> DataFrame:
    size = hours * 3600
    bucket = F.floor(F.col("created_at") / size) * size
    return since(log, as_of, days).where("response_ms IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.round(F.avg("response_ms"), 1).alias("avg_ms"), F.count("*").alias("count"))


def recent(log: DataFrame, limit: int = 20, key: str = "query") -> DataFrame:
    return log.orderBy(F.desc("created_at"), key).limit(limit)


def floor_percentiles(values: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """For each group, sorted[int(n q)] of each point, counted from 0, without interpolation; and count, mean, min, max, stddev.

    Values are ranked over range partitions: a group, however large, is spread over many tasks.
    """
    present = values.where(F.col(value).isNotNull())
    summed = present.groupBy(*by).agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"))
    picked = order.at_ranks(present, value, by, points).select(*[F.col(c).alias(f"_of_{c}") for c in by], *points)
    return summed.join(picked, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]).drop(*[f"_of_{c}" for c in by])


# --- query cache: (cache_key, query_text, response, route, created_at, expires_at, hit_count)


def cache_put(cache: DataFrame, entries: DataFrame, max_entries: int = 5000) -> DataFrame:
    """The cache with entries put in, the newest of each key, then without the least used and oldest beyond max_entries."""
    both = cache.unionByName(entries, allowMissingColumns=True)
    newest = both.withColumn("_n", F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("created_at"), "hit_count"))).where("_n = 1").drop("_n")
    return newest.orderBy(F.desc("hit_count"), F.desc("created_at"), "cache_key").limit(max_entries)


def cache_get(cache: DataFrame, queries: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Queries with their cached responses, and those to compute: not there or expired."""
    live = cache.where(F.col("expires_at") >= now)
    return queries.join(live.select("cache_key", "response"), "cache_key"), queries.join(live, "cache_key", "left_anti")


def cache_stats(cache: DataFrame, now: float) -> DataFrame:
    return cache.agg(F.count("*").alias("total_entries"), F.count_if(F.col("expires_at") > now).alias("active_entries"), F.count_if(F.col("expires_at") <= now).alias("expired_entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))


def cache_popular(cache: DataFrame, limit: int = 5) -> DataFrame:
    return cache.orderBy(F.desc("hit_count"), "cache_key").limit(limit).select("query_text", F.col("hit_count").alias("hits"))


# --- audit


def security_report(events: DataFrame) -> DataFrame:
    kind = F.lower("event_type")
    return events.agg(
        F.count("*").alias("total_events"), F.countDistinct("user_id").alias("unique_users"), F.count_if(kind == "login_failed").alias("failed_logins"),
        F.count_if(kind == "rate_limit_exceeded").alias("rate_limit_exceeded"), F.count_if(kind == "permission_denied").alias("permission_denied"),
    )


def breakdown(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("count"))


# --- process metrics


def counters(samples: DataFrame) -> DataFrame:
    """(name, value) of samples(name, value): sums."""
    return samples.groupBy("name").agg(F.sum("value").alias("value"))


def gauges(samples: DataFrame) -> DataFrame:
    """The last value of samples(name, value, ts)."""
    return samples.groupBy("name").agg(F.max_by("value", "ts").alias("value"))


def corpus_state(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.agg(F.count("*").alias("documents")).withColumn("state", F.when(F.col("documents") > 0, "ok").otherwise("degraded"))


def audit_event(kind, user: str = "user_id", severity: str = "info", action=None, result: str = "success", **details) -> list[Column]:
    """The columns of an audit event made from a row: texts are cut at 500 characters, details are JSON, the id is a hash of them all."""
    named = F.to_json(F.struct(*[F.substring(F.col(c).cast("string"), 1, 500).alias(n) for n, c in details.items()])) if details else F.lit("{}")
    event = kind if isinstance(kind, Column) else F.lit(kind)
    who = F.coalesce(F.col(user).cast("string"), F.lit(""))
    return [
        F.substring(F.sha2(F.concat_ws("|", event, who, named), 256), 1, 32).alias("event_id"), event.alias("event_type"), F.lit(severity).alias("severity"), F.col(user).alias("user_id"),
        F.coalesce(F.lit(action), event).alias("action"), F.lit(result).alias("result"), named.alias("details"),
    ]
