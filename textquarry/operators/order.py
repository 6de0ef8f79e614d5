"""Global order without gathering a group in one task: ranks by range partitions and prefix counts, exact quantiles, pages by rank or by seek token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store
from .retrieval import broadcast_if_few

_LOW_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def numbered(df: DataFrame, order: list[Column | str], by: list[str] = ()) -> DataFrame:
    """df with rank: 1, 2, ... in that order within each group of `by` (nulls are a group).

    The rows are range-partitioned by group and order, sorted and written; each knows its place in its partition. The rows of earlier
    partitions (one number for each partition) and the place where its group begins (one for each group) give its rank. A group of any size is
    spread over as many partitions as it fills; rows that the order doesn't tell apart stay together, so it should end with an id.
    """
    spark = df.sparkSession
    keys = [*by, *order]
    rows = store.saved(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOW_BITS).cast("int")
    before, base = [], 0
    for row in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):  # a row for each partition
        before.append((row["part"], base))
        base += row["n"]
    offsets = spark.createDataFrame(before, "_part int, _before long")
    placed = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << _LOW_BITS) - 1) + 1).drop("_part", "_before", "_at")
    if not by:
        return placed
    starts = placed.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg((F.min("rank") - 1).alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return placed.join(broadcast_if_few(starts), same).withColumn("rank", F.col("rank") - F.col("_start")).select(*df.columns, "rank")


def at_ranks(df: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """by and, for each point q, sorted[min(int(n q), n - 1)] of the values of a group, counted from 0: no interpolation. Nulls aren't values."""
    values = df.where(F.col(value).isNotNull()).select(*by, value).withColumn("_tie", F.monotonically_increasing_id())
    ranked = numbered(values, [value, "_tie"], by)
    sizes = broadcast_if_few(store.saved(ranked.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.max("rank").alias("_n"))))
    place = lambda q: F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1)
    wanted = ranked.join(sizes, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]).where((F.col("rank") - 1).isin(*[place(q) for q in points.values()]))
    return wanted.groupBy(*by).agg(*[F.max(F.when(F.col("rank") - 1 == place(q), F.col(value))).alias(name) for name, q in points.items()])


def page(df: DataFrame, number: int, size: int, order: list[Column | str]) -> DataFrame:
    """The rows of a page, counted from 1, with rank and total_pages (at least 1); order ends with an id, so reruns agree."""
    total = df.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("long").alias("total_pages"))
    return numbered(df, order).where(F.col("rank").between((number - 1) * size + 1, number * size)).crossJoin(F.broadcast(total))  # one row


def page_after(df: DataFrame, token: tuple | None, size: int, score: str, key: str) -> DataFrame:
    """The next rows by score, highest first, then key: those after the token (score, key) of the last row shown, None for the first page.

    No rank is computed and no earlier page read again: each task keeps its first `size` rows. Null scores come last.
    """
    score_of = F.col(score)
    if token is not None:
        last, at = token
        behind = score_of.isNull() & (F.col(key) > at) if last is None else (score_of < last) | ((score_of == last) & (F.col(key) > at)) | score_of.isNull()
        df = df.where(behind)
    return df.orderBy(score_of.desc_nulls_last(), key).limit(size)


def token_of(shown: DataFrame, score: str, key: str) -> tuple | None:
    """The seek token of a page: score and key of its last row; None for an empty page."""
    row = shown.orderBy(F.col(score).asc_nulls_first(), F.desc(key)).select(score, key).first()
    return row and tuple(row)


def sketched(df: DataFrame, value: str, by: list, k: int = 200) -> DataFrame:
    """by, n and a KLL sketch of the values of each group: of bounded size, in batch or as the state of a stream. Nulls aren't values."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list) -> DataFrame:
    """The sketches of finer groups as those of coarser ones: of hours as days, of batches as all."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def estimated(sketches: DataFrame, points: dict[str, float]) -> DataFrame:
    """The sketches' estimates: each has a rank within some 1.7 % of n (k = 200) of the one asked for, in 99 of 100 cases."""
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in points.items()])
