"""Mixing sources to target weights by weighted fair queueing.

1. Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share all words by weight; a target stops
   at `MAX_REPEATS` times its source's size, and the excess is shared again by weight until none is above.
2. Each source's documents are put in a shuffled order that a seed fixes. A document's virtual finish time is the
   source's words up to and with it, divided by the source's target; its second and third copies queue behind the
   whole source once and twice more.
3. All copies are range-sorted by finish time, and the queue is cut where its words reach the total budget.

Sums over sources and over the queue are made by range partitions, so a source that holds most rows is spread over
many tasks. Every input row is a document of its own (rows that repeat too). Empty and null texts have size 0 and take
nothing. No documents: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import saved, table
from .prefix import running_sums

MAX_REPEATS = 3
WEIGHTS = 3
SEED = "mix"


def _sizes(batches):
    for batch in (part for whole in batches for part in T.slices(whole, "text")):
        raw, offsets = T.utf8(batch.column("text"))
        _, _, first = T.words(raw, offsets, T.SPACE)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(np.diff(first).astype(np.int64))], names=["doc_id", "source", "size"])


def source_targets(sized: DataFrame) -> DataFrame:
    """source, weight, source_size, source_start (words of the sources before it), target of each source of (source, size)."""
    by_code_point = [F.col("source").isNull(), F.col("source")]
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    sources = running_sums(sources, by_code_point, {"nth": "one", "up_to": "source_size"})
    sources = sources.select("source", "source_size", (F.col("up_to") - F.col("source_size")).alias("source_start"), ((F.col("nth") - 1) % WEIGHTS + 1).alias("weight"))
    sources = sources.withColumn("cap", F.col("source_size") * MAX_REPEATS)
    # those that reach their cap first come first: from the first that doesn't reach it, all share by weight what is left
    filled = saved(running_sums(sources, [F.col("cap").cast("double") / F.col("weight"), *by_code_point], {"caps": "cap", "weights": "weight"}))
    totals = filled.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weights"))
    left = filled.crossJoin(F.broadcast(totals)).select(  # totals: one row
        "caps", "weight", "cap", (F.col("total") - F.col("caps") + F.col("cap")).alias("rest"), (F.col("all_weights") - F.col("weights") + F.col("weight")).alias("rest_weight")
    )
    below = left.where(F.col("rest").cast("double") * F.col("weight") <= F.col("cap").cast("double") * F.col("rest_weight"))
    level = below.agg(F.max_by(F.struct("rest", "rest_weight"), "rest_weight").alias("level")).select("level.*")  # one row
    share = F.col("weight").cast("double") * F.col("rest") / F.col("rest_weight")
    return filled.crossJoin(F.broadcast(level)).select("source", "weight", "source_size", "source_start", F.least(F.col("cap").cast("double"), F.coalesce(share, F.lit(0.0))).alias("target"))


def weighted_fair_mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs(doc_id, source, text): taken is size times the copies taken."""
    spark = docs.sparkSession
    sized = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(_sizes, "doc_id long, source string, size long").withColumn("rid", F.monotonically_increasing_id()))
    targets = saved(source_targets(sized))
    shuffled = sized.withColumn("shuffle", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    queue = running_sums(shuffled, [F.col("source").isNull(), F.col("source"), F.col("shuffle"), F.col("doc_id"), F.col("rid")], {"up_to": "size"})
    queue = queue.join(targets.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source"))).withColumn("cum", F.col("up_to") - F.col("source_start"))
    queue = saved(queue.select("doc_id", "rid", "shuffle", "size", "source_size", "target", "cum"))
    finish = lambda epoch: F.when(F.col("target") > 0, (F.col("cum") + F.col("source_size") * epoch).cast("double") / F.col("target"))
    order = ["finish", "shuffle", "doc_id", "rid", "epoch"]
    copies = queue.where("size > 0 and target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("epoch"))
    copies = copies.where(F.col("source_size") * F.col("epoch") <= F.col("target")).withColumn("finish", finish(F.col("epoch")))
    budget = queue.select("rid", "size").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    ranked = running_sums(copies.select(*order, "size"), [F.col(c) for c in order], {"words": "size"})
    cut = ranked.join(F.broadcast(budget)).where("words <= budget").agg(F.max(F.struct(*order)).alias("cut"))  # one row
    taken = sum((F.when((F.col("source_size") * e <= F.col("target")) & (F.struct(finish(F.lit(e)).alias("finish"), "shuffle", "doc_id", "rid", F.lit(e).alias("epoch")) <= F.col("cut")), 1).otherwise(0) for e in range(MAX_REPEATS)), F.lit(0))
    return queue.join(F.broadcast(cut)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.when(F.col("cut").isNotNull() & (F.col("size") > 0), taken).otherwise(0)).cast("long").alias("taken")
    )


def op8_weighted_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return weighted_fair_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def mix_sql(documents: str) -> str:
    """The mix of a table or CTE of that name, as a list of CTEs whose last is `mixed`; doc_id is taken to be unique."""
    return rf"""
sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM {documents}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {WEIGHTS} + 1 AS weight FROM sized GROUP BY source),
capped AS (SELECT *, source_size * {MAX_REPEATS} AS cap, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights FROM sources),
filled AS (SELECT *, CAST(total - sum(cap) OVER w + cap AS BIGINT) AS rest, CAST(all_weights - sum(weight) OVER w + weight AS BIGINT) AS rest_weight FROM capped
           WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
level AS (SELECT rest, rest_weight FROM filled WHERE CAST(rest AS DOUBLE) * weight <= CAST(cap AS DOUBLE) * rest_weight ORDER BY rest_weight DESC LIMIT 1),
targets AS (SELECT f.source, f.source_size, least(CAST(f.cap AS DOUBLE), coalesce(CAST(f.weight AS DOUBLE) * l.rest / l.rest_weight, 0)) AS target FROM filled f CROSS JOIN level l),
queued AS (SELECT s.doc_id, s.shuffle, s.size, t.source_size, t.target, CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.shuffle, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
           FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT doc_id, shuffle, size, epoch, CAST(cum + source_size * epoch AS DOUBLE) / target AS finish FROM queued, range({MAX_REPEATS}) r(epoch) WHERE size > 0 AND target > 0 AND source_size * epoch <= target),
ranked AS (SELECT *, sum(size) OVER (ORDER BY finish, shuffle, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS words FROM copies),
admitted AS (SELECT doc_id, count(*) AS n FROM ranked WHERE words <= (SELECT sum(size) FROM sized) GROUP BY doc_id),
mixed AS (SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(a.n, 0) AS BIGINT) AS taken FROM queued q LEFT JOIN admitted a ON a.doc_id = q.doc_id)
"""


OP8_SQL = f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"
