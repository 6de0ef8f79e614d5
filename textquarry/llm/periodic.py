"""Periodic run detection by harmonic grid probing.

A run is a stretch of consecutive words with smallest period p (words p apart are identical) and a length of at least
max(`MIN_LENGTH`, `MIN_PERIODS` * p) that no neighbouring word extends.

1. Words are numbered by their exact bytes, so that whole arrays of words can be compared.
2. Probing: for each period p, words are compared at the grid points jp and (j+1)p, jp and (j+1)p being both equal to the
   word p further on, and then at points between them. The words at which a run equals itself p further on
   number at least 2p, so they hold two adjacent grid points: no run is missed. All grid points are n log n in number.
3. Survivors go by rising period: one within a run found already is skipped (a stretch of 2p + 1 words in a run
   of smaller period has that period's runs only), any other is extended to both sides by comparing
   chunks of words that double in length, and is a run if it is long enough.

Each row is a document of its own. Null and empty texts have no words and no runs; words are told apart by case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import packed, table, unpacked

MIN_LENGTH = 24
MIN_PERIODS = 3
#: Grid points probed at once.
PROBED = 1 << 20
#: White space that parts words.
BLANKS = r"\x20\x09-\x0D"


def probed(words: np.ndarray, first: np.ndarray):
    """(document, period, grid point) arrays of the grid points that survive probing, by document and rising period.

    words: the numbers of all documents' words; document i has those from first[i] to first[i + 1].
    """
    sizes = np.diff(first)
    periods = np.where(sizes >= MIN_LENGTH, sizes // MIN_PERIODS, 0)
    upto = np.concatenate(([0], np.cumsum(periods)))
    lo = 0
    step = max(1, PROBED // 16)
    while lo < upto[-1]:
        hi = min(lo + step, upto[-1])
        doc = np.searchsorted(upto, np.arange(lo, hi), side="right") - 1
        p = np.arange(lo, hi) - upto[doc] + 1
        points = (sizes[doc] - 1) // p - 1  # (j + 2) p is a word still
        ends = np.cumsum(points)
        cut = 0
        while cut < len(p):  # as many (document, period) as have some PROBED grid points together
            base = ends[cut - 1] if cut else 0
            to = max(cut + 1, int(np.searchsorted(ends, base + PROBED, side="right")))
            of = np.repeat(np.arange(cut, to), points[cut:to])
            j = np.arange(len(of)) - np.repeat(ends[cut:to] - points[cut:to] - base, points[cut:to])
            at = first[doc[of]] + j * p[of]
            ok = np.flatnonzero(words[at] == words[at + p[of]])
            for share in (4, 2, 1, 3):  # (j + 1) p, then points between
                ok = ok[words[at[ok] + p[of[ok]] * share // 4] == words[at[ok] + p[of[ok]] * share // 4 + p[of[ok]]]]
            yield doc[of[ok]], p[of[ok]], j[ok] * p[of[ok]]
            cut = to
        lo = hi


def _equal_upto(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of two arrays of one length agree; chunks double in length."""
    done, chunk = 0, 32
    while done < len(a):
        differ = a[done : done + chunk] != b[done : done + chunk]
        if differ.any():
            return done + int(differ.argmax())
        done += len(differ)
        chunk *= 2
    return done


def found_runs(words: np.ndarray, p: np.ndarray, points: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of one document's runs by start, then period; p, points: its surviving grid points by rising period."""
    runs: list[tuple[int, int, int]] = []
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the runs by start: the furthest end of those up to each
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1, [len(p)]))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        period, at = int(p[lo]), points[lo:hi]
        if len(starts):
            before = np.searchsorted(starts, at, side="right") - 1
            at = at[(before < 0) | (reach[np.maximum(before, 0)] < at + 2 * period + 1)]
        own, past = [], -1
        for point in at.tolist():
            if point < past:  # in the stretch just extended
                continue
            past = point + _equal_upto(words[point:-period], words[point + period :])
            start = point - _equal_upto(words[:point][::-1], words[period : point + period][::-1])
            length = past - start + period
            if length >= max(MIN_LENGTH, MIN_PERIODS * period):
                own.append((start, length, period))
        if own:
            runs += own
            order = sorted((s, s + n) for s, n, _ in runs)
            starts, reach = np.array([s for s, _ in order]), np.maximum.accumulate(np.array([e for _, e in order]))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _scanned(batches):
    for batch in (part for whole in batches for part in T.slices(whole, "text")):
        raw, offsets = T.utf8(batch.column("text"))
        starts, ends, first = T.words(raw, offsets, T.SPACE)
        words, _ = T.numbered(raw, starts, ends)
        parts = list(probed(words, first))
        doc, p, point = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        runs = [found_runs(words[first[i] : first[i + 1]], p[cuts[i] : cuts[i + 1]], point[cuts[i] : cuts[i + 1]]) if cuts[i] < cuts[i + 1] else [] for i in range(batch.num_rows)]
        texts = []
        memory = raw.tobytes()
        for i, own in enumerate(runs):
            lo, hi = first[i], first[i + 1]
            keep = np.ones(hi - lo, dtype=bool)
            for start, length, period in own:
                keep[start + period : start + length] = False
            kept = np.flatnonzero(keep) + lo
            texts.append(b" ".join([memory[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]))
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in batch.schema.names if n != "text"), pa.array(np.diff(first).astype(np.int64)), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], kind), pa.array(texts, pa.binary()).cast(pa.string())],
            names=[*(n for n in batch.schema.names if n != "text"), "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), collapsed (the words that stay, joined by spaces).

    A word goes if any run contains it after that run's first period of words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scanned, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def without_repetition(docs: DataFrame) -> DataFrame:
    """docs with the words of runs collapsed to one period in their texts; texts without runs stay as they are, all other columns too."""
    apart = packed(docs)
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rest {apart.schema['rest'].dataType.simpleString()}, text string"

    def run(batches):
        for batch in batches:
            for part, out in zip(T.slices(batch, "text"), _scanned(iter([batch])), strict=True):
                any_run = pa.compute.greater(pa.compute.list_value_length(out.column("runs")), 0)
                text = pa.compute.if_else(any_run, out.column("collapsed"), part.column("text").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rest"), text], names=["doc_id", "rest", "text"])

    return unpacked(apart.mapInArrow(run, kinds), docs.columns)


def strongest(runs: str | Column = "runs") -> Column:
    """The run with the greatest exact length / period; ties: smallest start, then period. Null without runs."""
    ahead = lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1)
    by = lambda a, b: ahead(a, b).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
    return F.get(F.array_sort(runs, by), 0)


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), every tenth by a hash of its id made periodic from some word on, as the query's contract states it.

    Null ids have no hash: those texts stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[^{BLANKS}]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / F.lit(10)).alias("g")).select("doc_id", "text", "w", "g", F.size("w").alias("n"))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.when(F.col("n") > 0, F.expr("1 + (n - a) div (3 + g % 8)")))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("w", at(i).cast("int"))), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", strongest())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _nibble_crc(value: int) -> int:
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


_NIBBLES = "list_transform(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ord(x) & 15, ord(x) >> 4])), lambda x: x::BIGINT)"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_NIBBLES}), lambda c, x: xor([{', '.join(str(_nibble_crc(i)) for i in range(16))}][(xor(c, x) & 15) + 1]::BIGINT, c >> 4)), 4294967295)"
#: Equal words p apart by joins, their islands by gaps; periods are those that some grid point leaves.
OP11_SQL = rf"""
WITH hashed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{BLANKS}]+') AS w, {_CRC} AS h FROM documents),
sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM hashed), made AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
planted AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w FROM made),
pos AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM planted),
grid AS (SELECT doc_id, p, unnest(range((n - 1) // p - 1)) * p AS i FROM (SELECT doc_id, n, unnest(range(1, n // {MIN_PERIODS} + 1)) AS p FROM planted WHERE n >= {MIN_LENGTH})),
periods AS (SELECT DISTINCT g.doc_id, g.p FROM grid g JOIN pos a ON a.doc_id = g.doc_id AND a.i = g.i JOIN pos b ON b.doc_id = g.doc_id AND b.i = g.i + g.p AND b.word = a.word JOIN pos c ON c.doc_id = g.doc_id AND c.i = g.i + 2 * g.p AND c.word = a.word),
same AS (SELECT q.doc_id, q.p, a.i FROM periods q JOIN pos a ON a.doc_id = q.doc_id JOIN pos b ON b.doc_id = a.doc_id AND b.i = a.i + q.p AND b.word = a.word),
spans AS MATERIALIZED (SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same) GROUP BY doc_id, p, island HAVING count(*) + p >= greatest({MIN_LENGTH}, {MIN_PERIODS} * p)),
runs AS MATERIALIZED (SELECT * FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y WHERE y.doc_id = x.doc_id AND y.p < x.p AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
listed AS (SELECT doc_id, count(*) AS n_runs, arg_min(s, o) AS start, arg_min(l, o) AS length, arg_min(p, o) AS period, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / p DESC, s, p) AS o FROM runs) GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n_runs, 0) AS n_runs, r.start, r.length, r.period, 1000 * r.length // r.period AS exponent_milli, sha256(coalesce(r.line, '')) AS runs_sha256, sha256(coalesce(k.line, '')) AS collapsed_sha256
FROM planted d LEFT JOIN listed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
