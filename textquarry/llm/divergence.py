"""Source divergence audit by inclusion-exclusion over supports.

Each language keeps the terms that enough of its documents hold. A kept term's price in a group (lang, source), or in a
whole language, is p(count) = 1 + floor(`UNIT` * (count + `SMOOTHING`) / (N + `SMOOTHING` * V)), N the group's occurrences of
kept terms, V the number of these; z = p(0). The distance of two groups a, b is the sum of |p_a - p_b| over all V kept terms:

* one-sided terms: the sum over a's terms of |p_a - z_b|, and over b's of |z_a - p_b|. p_a hangs on the count alone, so a
  histogram (count, number of terms) of each group is priced, not its terms;
* overlaps: a term of both was counted on either side and isn't at z anywhere. A join of the sparse postings on the term, for
  a < b, adds |p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b| for each;
* both zero: (V - terms of a - terms of b) * |z_a - z_b|, a constant of the pair, as if no term were of both.

Terms are counted where they are read (some `BATCHED` bytes of text at a time), so a group with most rows sends one row for
each of its terms from each batch. A join on a term meets at most one row for each source. The histograms meet their language's
groups under salted keys. All arithmetic is in integers, where products may exceed 64 bits in decimals.

Null text, lang and source are ''. Each row is a document of its own, ids aren't read; repeated rows count again. A group without
terms has N = 0; in a language that keeps no terms all distances are 0. No documents: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import saved, shuffle_partitions, table

MIN_DOCUMENTS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
#: Bytes of text that a task counts at a time.
BATCHED = 12 << 20


def _gathered(batches):
    """Record batches of about BATCHED bytes each."""
    held, size = [], 0
    for batch in batches:
        for part in T.slices(batch, "text", BATCHED):
            held.append(part)
            size += part.nbytes
            if size >= BATCHED:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _counted(batches):
    for rows in _gathered(batches):
        columns = {c: rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")}
        lang, source = (columns[c].indices.to_numpy().astype(np.int64) for c in ("lang", "source"))
        group_of = lang * len(columns["source"].dictionary) + source
        raw, offsets = T.utf8(rows.column("text"))
        raw = T.LOWER[raw]
        starts, ends, first = T.words(raw, offsets, T.NOT_LETTER)
        terms, dictionary = T.numbered(raw, starts, ends)
        n_terms = max(1, len(dictionary))
        doc = np.repeat(np.arange(rows.num_rows), np.diff(first))
        in_docs, occurrences = np.unique(doc * n_terms + terms, return_counts=True)  # (document, term)
        key = group_of[in_docs // n_terms] * n_terms + in_docs % n_terms
        pairs, at = np.unique(key, return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, at, occurrences)
        groups = np.unique(group_of)  # a row without term for each group: those without terms are groups too
        group = np.concatenate([pairs // n_terms, groups])
        none = np.zeros(len(groups), np.int64)
        take = lambda c, i: columns[c].dictionary.take(pa.array(i))
        term = pa.concat_arrays([dictionary.take(pa.array(pairs % n_terms)).cast(pa.string()), pa.nulls(len(groups), pa.string())])
        width = len(columns["source"].dictionary)
        out = [take("lang", group // width), take("source", group % width), term, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([np.bincount(at, minlength=len(pairs)).astype(np.int64), none]))]
        whole = pa.RecordBatch.from_arrays(out, names=["lang", "source", "term", "n", "documents"])
        yield from (whole.slice(i, 1 << 16) for i in range(0, whole.num_rows, 1 << 16))


def kept_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n) of the kept terms that occur in each group, and a row of null term for each group."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = texts.mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    # one shuffle: what is dealt by (lang, term) is together by (lang, term, source) as well
    dealt = counted.repartition(shuffle_partitions(docs.sparkSession), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    in_lang = F.sum("documents").over(Window.partitionBy("lang", "term"))
    return dealt.withColumn("in_lang", in_lang).where((F.col("in_lang") >= min_documents) | F.col("term").isNull()).select("lang", "source", "term", "n")


def price(count: Column, total: Column, terms: Column) -> Column:
    """p(count) of a group with that total; null where no terms are kept."""
    long = lambda c: c.cast("decimal(20,0)")
    parts = F.struct((F.lit(UNIT).cast("decimal(10,0)") * long(count + SMOOTHING)).alias("above"), F.nullif(long(total + terms * SMOOTHING), F.lit(0).cast("decimal(20,0)")).alias("below"))
    return F.lit(1) + F.call_function("div", parts["above"], parts["below"])


def _groups(kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, all_terms, lang_total, z) of each group."""
    posts = kept.where("term IS NOT NULL")
    own = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    by_term = posts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    whole = by_term.groupBy("lang").agg(F.count("*").alias("all_terms"), F.sum("n").alias("lang_total"))
    known = kept.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["total", "terms", "all_terms", "lang_total"])
    return known.withColumn("z", F.coalesce(price(F.lit(0).cast("long"), F.col("total"), F.col("all_terms")), F.lit(0)))


def distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each group from each other source of its language."""
    salts = shuffle_partitions(kept.sparkSession)
    priced = kept.where("term IS NOT NULL").join(groups, ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("total"), F.col("all_terms")))
    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"), F.col("terms").alias("other_terms"))
    apart = lambda a, b: F.abs(F.col(a) - F.col(b))

    histogram = priced.groupBy("lang", "source", "n").agg(F.count("*").alias("times"), F.first("p").alias("p")).withColumn("salt", F.pmod(F.hash("source", "n"), F.lit(salts)))
    salted = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    one_sided = histogram.join(salted, ["lang", "salt"]).where("source <> other").select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("times") * apart("p", "other_z")).alias("value"))

    left = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    overlaps = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", (apart("pa", "pb") - apart("pa", "zb") - apart("za", "pb") + apart("za", "zb")).alias("value"))

    both_zero = groups.join(other, "lang").where("source < other").select("lang", F.col("source").alias("a"), F.col("other").alias("b"), ((F.col("all_terms") - F.col("terms") - F.col("other_terms")) * apart("z", "other_z")).alias("value"))

    summed = one_sided.unionByName(overlaps).unionByName(both_zero).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")


def marked_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a group has more of than its language, by how much."""
    posts = kept.where("term IS NOT NULL")
    in_lang = posts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    both = posts.join(in_lang, ["lang", "term"]).join(groups, ["lang", "source"])
    more = price(F.col("n"), F.col("total"), F.col("all_terms")) - price(F.col("lang_n"), F.col("lang_total"), F.col("all_terms"))
    return both.select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank over docs(lang, source, text).

    pair: the distance from each other source of the language, all ranks; term: the terms that mark the group, the first top_terms.
    """
    kept = saved(kept_counts(docs, min_documents))
    groups = saved(_groups(kept))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    return ranked(distances(kept, groups), "pair").unionByName(ranked(marked_terms(kept, groups), "term").where(F.col("rank") <= top_terms))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all documents."""
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


_UPPER, _LOWER = (bytes(range(at, at + 26)).decode() for at in (0x41, 0x61))
#: Sums over all kept terms of each pair of groups, without histograms or supports.
OP12_SQL = rf"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
gr AS (SELECT DISTINCT lang, source FROM docs),
dfs AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= {MIN_DOCUMENTS}),
occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM docs) SEMI JOIN dfs USING (lang, term) GROUP BY ALL),
full_counts AS (SELECT gr.lang, gr.source, dfs.term, coalesce(occ.n, 0) AS n FROM gr JOIN dfs ON dfs.lang = gr.lang LEFT JOIN occ ON occ.lang = gr.lang AND occ.source = gr.source AND occ.term = dfs.term),
ps AS (SELECT lang, source, term, n, 1 + CAST(({UNIT}::HUGEINT * (n + {SMOOTHING})) // (sum(n) OVER g + {SMOOTHING} * count(*) OVER g) AS BIGINT) AS p FROM full_counts WINDOW g AS (PARTITION BY lang, source)),
ql AS (SELECT lang, term, 1 + CAST(({UNIT}::HUGEINT * (n + {SMOOTHING})) // (sum(n) OVER g + {SMOOTHING} * count(*) OVER g) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM full_counts GROUP BY ALL) WINDOW g AS (PARTITION BY lang)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pr.value, 0) AS BIGINT) AS value FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
terms AS (SELECT ps.lang, ps.source, 'term' AS part, ps.term AS item, ps.p - ql.q AS value FROM ps JOIN ql USING (lang, term) WHERE ps.n > 0 AND ps.p > ql.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER r AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) WINDOW r AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
