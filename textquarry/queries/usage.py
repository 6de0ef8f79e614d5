"""Queries of analytics, caches, audit, limiters and time windows over events: event_type is the route, value the response time or confidence, ts the time, user_id the client."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..streaming import limiters
from .common import table

QUERIES: dict = {}
AS_OF = 1706659200  # the end of the events, 2024-01-31


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


_LOG = "log AS (SELECT event_type || ':' || (user_id % 10) AS query, event_type AS route, value * 10 AS confidence, (user_id % 7)::INT AS result_count, CASE WHEN event_id % 11 <> 0 THEN value END AS response_ms, event_id % 3 = 0 AS cache_hit, floor(epoch(ts))::BIGINT AS created_at, event_id FROM events)"


def log(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.concat("event_type", F.lit(":"), (F.col("user_id") % 10).cast("string")).alias("query"), F.col("event_type").alias("route"), (F.col("value") * 10).alias("confidence"), (F.col("user_id") % 7).cast("int").alias("result_count"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("response_ms"), (F.col("event_id") % 3 == 0).alias("cache_hit"), A.epoch("ts").alias("created_at"), "event_id",
    )


@query("analytics_overview", f"WITH {_LOG} SELECT count(*) AS total_queries, round(avg(response_ms), 1) AS avg_response_ms, round(count(*) FILTER (cache_hit) / count(*) * 100, 1) AS cache_hit_rate FROM log WHERE created_at > {AS_OF} - 20 * 86400")
def _(spark, d):
    return A.overview(log(spark, d), AS_OF, 20)


@query("domain_breakdown", f"WITH {_LOG} SELECT route, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 1) AS percent FROM log WHERE created_at > {AS_OF} - 10 * 86400 AND route IS NOT NULL GROUP BY route")
def _(spark, d):
    return A.domains(log(spark, d), AS_OF, 10)


@query("hourly_distribution", f"WITH {_LOG} SELECT created_at // 3600 AS hour, count(*) AS count FROM log WHERE created_at > {AS_OF} - 7 * 86400 GROUP BY 1")
def _(spark, d):
    return A.hourly(log(spark, d), AS_OF, 7)


@query("value_band_histogram", f"WITH {_LOG} SELECT CASE WHEN confidence >= 75 THEN 'high' WHEN confidence >= 50 THEN 'medium' WHEN confidence >= 25 THEN 'low' ELSE 'very_low' END AS level, count(*) AS count FROM log WHERE confidence IS NOT NULL GROUP BY 1")
def _(spark, d):
    return A.confidence_bands(log(spark, d))


@query("trend_6h", f"WITH {_LOG} SELECT created_at // 21600 * 21600 AS bucket, round(avg(response_ms), 1) AS avg_ms, count(*) AS count FROM log WHERE response_ms IS NOT NULL AND created_at > {AS_OF} - 14 * 86400 GROUP BY 1")
def _(spark, d):
    return A.trend(log(spark, d), AS_OF, 14)


@query("recent_events", f"WITH {_LOG} SELECT event_id, route, created_at FROM log ORDER BY created_at DESC, event_id LIMIT 20")
def _(spark, d):
    return A.recent(log(spark, d).select("event_id", "route", "created_at"), 20, "event_id")


@query("popular_queries", f"WITH {_LOG} SELECT query, count(*) AS count, coalesce(round(avg(response_ms), 1), 0) AS avg_ms FROM log GROUP BY query HAVING max(created_at) > {AS_OF} - 30 * 86400 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return A.popular(log(spark, d), 10, AS_OF, 30)


@query("query_patterns", f"WITH {_LOG} SELECT query, count(*) AS count, round(CASE WHEN count(response_ms) = count(*) THEN avg(response_ms) END, 6) AS avg_ms, max(created_at) AS last_seen FROM log GROUP BY query")
def _(spark, d):
    return A.patterns(log(spark, d), poison=True).withColumn("avg_ms", F.round("avg_ms", 6))


@query("popular_users", "SELECT user_id, count(*) AS count, round(sum(value), 4) AS total FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("count"), F.round(F.sum("value"), 4).alias("total")).orderBy(F.desc("count"), "user_id").limit(15)


@query("latency_percentiles_floor_index", """WITH r AS (SELECT event_type, value, count(*) OVER w AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type))
    SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS stddev, max(value) FILTER (i = floor(n * 0.5)) AS p50, max(value) FILTER (i = floor(n * 0.95)) AS p95, max(value) FILTER (i = floor(n * 0.99)) AS p99 FROM r GROUP BY event_type""")
def _(spark, d):
    out = A.floor_percentiles(table(spark, d, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return out.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("tumbling_counts", "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS count FROM events GROUP BY ALL")
def _(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("count")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "count")


@query("session_counts", """WITH g AS (SELECT user_id, epoch(ts) AS t, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800 THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, floor(min(t))::BIGINT AS start, count(*) AS events FROM s GROUP BY user_id, n""")
def _(spark, d):
    w = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    return table(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events")).select("user_id", F.unix_timestamp("w.start").alias("start"), "events")


@query("sliding_offered_load", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS load FROM events""")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3599, 0)
    return table(spark, d, "events").withColumn("t", A.epoch("ts")).select("event_id", F.count("*").over(w).alias("load"))


@query("cache_stats", f"""WITH {_LOG}, c AS (SELECT substring(sha256(query), 1, 32) AS cache_key, max(created_at) AS created_at, max(created_at) + 86400 AS expires_at, count(*) FILTER (cache_hit) AS hit_count FROM log GROUP BY query)
    SELECT count(*) AS total_entries, count(*) FILTER (expires_at > {AS_OF - 3600}) AS active_entries, count(*) FILTER (expires_at <= {AS_OF - 3600}) AS expired_entries, sum(hit_count)::BIGINT AS hits FROM c""")
def _(spark, d):
    return A.cache_stats(_cache(spark, d), AS_OF - 3600)


def _cache(spark, d):
    from ..functions import text as T

    return log(spark, d).groupBy("query").agg(F.max("created_at").alias("created_at"), F.count_if("cache_hit").alias("hit_count")).select(
        T.cache_key("query").alias("cache_key"), F.col("query").alias("query_text"), F.concat(F.lit("answer to "), "query").alias("response"), "created_at", (F.col("created_at") + 86400).alias("expires_at"), "hit_count"
    )


@query("cache_popular", f"""WITH {_LOG} SELECT query AS query_text, count(*) FILTER (cache_hit) AS hits FROM log GROUP BY query ORDER BY 2 DESC, substring(sha256(query), 1, 32) LIMIT 5""")
def _(spark, d):
    return A.cache_popular(_cache(spark, d))


@query("cache_eviction", f"""WITH {_LOG}, c AS (SELECT query, max(created_at) AS created_at, count(*) FILTER (cache_hit) AS hit_count FROM log GROUP BY query) SELECT query AS query_text, hit_count FROM c ORDER BY hit_count DESC, created_at DESC, substring(sha256(query), 1, 32) LIMIT 12""")
def _(spark, d):
    cache = _cache(spark, d)
    return A.cache_put(cache, cache.where("false"), 12).select("query_text", "hit_count")


@query("cache_aside", f"""WITH {_LOG}, c AS (SELECT query, max(created_at) + 86400 AS expires_at FROM log GROUP BY query), q AS (SELECT DISTINCT lower(event_type) || ':' || x AS query FROM events, range(0, 13) r(x))
    SELECT q.query, c.query IS NOT NULL AS hit FROM q LEFT JOIN c ON c.query = q.query AND c.expires_at >= {AS_OF - 1800}""")
def _(spark, d):
    from ..functions import text as T

    asked = table(spark, d, "events").select("event_type").distinct().crossJoin(spark.range(13)).select(F.concat("event_type", F.lit(":"), F.col("id").cast("string")).alias("query")).withColumn("cache_key", T.cache_key("query"))
    hits, misses = A.cache_get(_cache(spark, d), asked, AS_OF - 1800)
    return hits.select("query", F.lit(True).alias("hit")).unionByName(misses.select("query", F.lit(False).alias("hit")))


@query("audit_security_report", "SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users, count(*) FILTER (event_type = 'error') AS failed_logins, count(*) FILTER (event_type = 'click' AND value > 50) AS rate_limit_exceeded, 0 AS permission_denied FROM events")
def _(spark, d):
    kind = F.when(F.col("event_type") == "error", "LOGIN_FAILED").when((F.col("event_type") == "click") & (F.col("value") > 50), "rate_limit_exceeded").otherwise(F.col("event_type"))
    return A.security_report(table(spark, d, "events").select("user_id", kind.alias("event_type"))).withColumn("permission_denied", F.col("permission_denied").cast("int"))


@query("user_activity_report", "SELECT user_id, event_type, count(*) AS count FROM events GROUP BY ALL")
def _(spark, d):
    return A.breakdown(table(spark, d, "events"), ["user_id", "event_type"])


@query("metrics_counters", "SELECT event_type AS name, round(sum(value), 4) AS value, max_by(value, event_id) AS last FROM events GROUP BY 1")
def _(spark, d):
    samples = table(spark, d, "events").select(F.col("event_type").alias("name"), "value", F.col("event_id").alias("ts"))
    return A.counters(samples).select("name", F.round("value", 4).alias("value")).join(A.gauges(samples).withColumnRenamed("value", "last"), "name")


@query("index_status", "SELECT count(*) AS documents, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'degraded' END AS state FROM documents")
def _(spark, d):
    return A.corpus_state(table(spark, d, "documents"))


@query("prometheus_lines", """SELECT 'requests_total{route="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def _(spark, d):
    from ..sources import writers

    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    return writers.prometheus(counts.select(F.lit("requests_total").alias("name"), F.create_map(F.lit("route"), "event_type").alias("labels"), "value"))


# --- keyed state, replayed over the log


@query("token_bucket_replay", """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT event_id, user_id, t, n, 3.0::DOUBLE AS had, true AS allowed FROM e WHERE n = 1
    UNION ALL SELECT e.event_id, e.user_id, e.t, e.n, least(3, w.had - CASE WHEN w.allowed THEN 1 ELSE 0 END + (e.t - w.t) / 14400), least(3, w.had - CASE WHEN w.allowed THEN 1 ELSE 0 END + (e.t - w.t) / 14400) >= 1 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT event_id, user_id, allowed FROM w""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return limiters.replay(e, "user_id", "t", "event_id", limiters.TokenBucket(3, 1 / 14400)).select("event_id", "user_id", "allowed")


@query("sliding_window_replay", """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT event_id, user_id, n, [t] AS kept, true AS allowed FROM e WHERE n = 1
    UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN len(list_filter(w.kept, lambda x: x > e.t - 43200)) < 2 THEN list_append(list_filter(w.kept, lambda x: x > e.t - 43200), e.t) ELSE list_filter(w.kept, lambda x: x > e.t - 43200) END,
        len(list_filter(w.kept, lambda x: x > e.t - 43200)) < 2 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT event_id, user_id, allowed FROM w""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return limiters.replay(e, "user_id", "t", "event_id", limiters.SlidingWindow(2, 43200)).select("event_id", "user_id", "allowed")


@query("ttl_cache_replay", """WITH RECURSIVE e AS (SELECT event_id, event_type || '|' || user_id AS k, epoch(ts) AS t, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT event_id, k, n, t + 172800 AS until, false AS allowed FROM e WHERE n = 1
    UNION ALL SELECT e.event_id, e.k, e.n, CASE WHEN w.until >= e.t THEN w.until ELSE e.t + 172800 END, w.until >= e.t FROM w JOIN e ON e.k = w.k AND e.n = w.n + 1)
    SELECT event_id, k, allowed FROM w""")
def _(spark, d):
    e = table(spark, d, "events").select(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("k"), "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return limiters.replay(e, "k", "t", "event_id", limiters.TtlEntry(172800)).select("event_id", "k", "allowed")
