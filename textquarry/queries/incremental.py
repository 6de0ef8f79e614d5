"""Queries of streams and stores that take each thing once, over the given tables dealt out as files that arrive one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import text as T
from ..operators.keystore import KeyStore
from ..streaming import limiters, upserts
from .common import sql_tokens, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def arriving(df: DataFrame, parts: int, by: str) -> tuple[DataFrame, str]:
    """df as a stream of `parts` files, one a batch, and the folder they are in: rows are dealt to them by a hash, so times come in no order."""
    spark = df.sparkSession
    path = f"{store.folder(spark)}/in"
    df.repartition(parts, F.pmod(F.xxhash64(by), F.lit(parts))).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), path


def run_through(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _usage(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.lit(1).cast("long").alias("n"), F.coalesce("value", F.lit(0.0)).alias("total"), F.unix_micros(F.col("ts").cast("timestamp")).alias("last"))


@query("stream_upserts", "SELECT user_id, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total, max(epoch_us(ts)) AS last FROM events GROUP BY user_id")
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "value", "ts")
    stream, path = arriving(events, 5, "event_id")
    running = upserts.RunningTable(spark, store.folder(spark), ["user_id"], {"n": "sum", "total": "sum", "last": "max"}, "user_id long, n long, total double, last long")
    run_through(running.sink(stream, store.folder(spark), prepared=_usage))
    for number in (0, 3):  # batches that come a second time
        running.apply(_usage(spark.read.parquet(path)), number)
    return running.table().withColumn("total", F.round("total", 4))


@query("stream_reindex", f"SELECT doc_id, source, len({sql_tokens('text')})::INT AS n_tokens, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS version FROM documents WHERE lang IS DISTINCT FROM 'fr'")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    top = store.folder(spark)
    first = docs.withColumns({"version": F.lit(1), "gone": F.lit(False)})
    second = docs.where("lang = 'en' OR lang = 'fr'").withColumns({"version": F.lit(2), "gone": F.col("lang") == "fr"})
    for rows in (first, second):  # a growing folder, read as far as it has grown
        rows.write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema(first.schema).parquet(f"{top}/in")
        indexed = lambda df: df.select("doc_id", "source", F.size(T.tokens("text")).alias("n_tokens"), "version", "gone")
        run_through(upserts.reindexer(stream, f"{top}/index", f"{top}/checkpoint", "source", "doc_id", "version", indexed))
    return spark.read.parquet(f"{top}/index").where("NOT gone").select("doc_id", "source", "n_tokens", "version")


_LIMITED = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) / 1000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
    w AS (SELECT event_id, user_id, n, [t] AS kept, true AS allowed FROM e WHERE n = 1
    UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN len(list_filter(w.kept, lambda x: x > e.t - 43200)) < 2 THEN list_append(list_filter(w.kept, lambda x: x > e.t - 43200), e.t) ELSE list_filter(w.kept, lambda x: x > e.t - 43200) END,
        len(list_filter(w.kept, lambda x: x > e.t - 43200)) < 2 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT event_id, user_id, allowed FROM w"""


@query("limits_in_event_time", _LIMITED)
def _(spark: SparkSession, d):
    events = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    top = store.folder(spark)
    stream, path = arriving(events, 4, "event_id")
    last = events.agg(F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("user_id"), (F.max("ts") + F.expr("interval 900 days")).alias("ts"))
    last.write.mode("append").parquet(path)  # the newest file comes last: the watermark passes all requests
    before = spark.conf.get(limiters.STATE_STORE[0])
    spark.conf.set(*limiters.STATE_STORE)
    try:
        limited = limiters.in_event_time(stream, "user_id", "ts", "event_id", limiters.SlidingWindow(2, 43200), late="400 days", idle="1 day")
        run_through(limited.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint"))
    finally:
        spark.conf.set(limiters.STATE_STORE[0], before)
    return spark.read.parquet(f"{top}/out").select(F.col("id").alias("event_id"), F.col("key").cast("long").alias("user_id"), "allowed")


@query("unknown_keys", "SELECT DISTINCT md5(text) AS key FROM documents WHERE source >= 'src5' AND text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source < 'src5' AND text IS NOT NULL)")
def _(spark, d):
    hashed = table(spark, d, "documents").select("source", F.md5("text").alias("key"))
    known = KeyStore(spark, store.folder(spark))
    known.append(hashed.where("source < 'src2'"))
    known.append(hashed.where("source < 'src5'"))
    return known.unknown(hashed.where("source >= 'src5'"))[0]
