"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

1. Each text becomes the set of hashes of its shingles of `SHINGLE` successive words (runs of non-white-space, A-Z
   lower-cased; a text of fewer words is one shingle of them all). Texts of equal sets are copies: they make one class,
   and only its representative, the smallest id, is compared.
2. `BANDS` x `ROWS` MinHash values; representatives that agree on a band share a bucket. Each bucket links its members to
   its first one, not to each other; connected components of these links are the candidate groups. A pair of
   similarity 0.8 shares no bucket with a probability of 4e-7.
3. A group is dealt to blocks of bounded size, and pairs of blocks are compared in separate tasks. Pairs that share a
   bucket are candidates. Their MinHash values are compared 16 at a time, and a pair is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold falls below `TOLERANCE`.
4. What is left is verified exactly on the shingle sets. A task returns how many documents each representative links to,
   and a spanning forest of the links: never all pairs.
5. Connected components of the forests are the classes of near copies.

Null and empty texts have no shingles: they link to nothing and are each a class of their own. Null ids count as
one id after all others and come back as null. Rows that repeat are copies of each other and link to each other.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import LAST_ID, ordered_id, packed, saved, shuffle_partitions, table, unpacked
from .graph import connected_components

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 28, 4
TOLERANCE = 1e-6
STEP = 16
#: Members and shingles of a block of a candidate group, about: two blocks are in memory at a time.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 2_000_000

_HASHES = BANDS * ROWS
_MULTIPLIERS = np.random.RandomState(5).randint(1, 2**63 - 1, _HASHES, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def shingle_sets(column, size: int = SHINGLE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and n + 1 bounds. seed: 0 or 1, two independent hash functions."""
    raw, offsets = T.utf8(column)
    starts, ends, first = T.words(raw, offsets, T.SPACE)
    grams, bounds = T.grams(T.hashes(raw, starts, ends, seed), first, size)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        grams[lo:hi].sort()
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(len(bounds)))


def minhashes(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of uint32 values for each text that has shingles; others have undefined rows."""
    out = np.zeros((len(bounds) - 1, _HASHES), dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    lo = 0
    while lo < len(full):
        base = bounds[full[lo]]
        hi = max(lo + 1, int(np.searchsorted(bounds[full + 1], base + 30_000, side="right")))
        rows = full[lo:hi]
        part = grams[base : bounds[rows[-1] + 1]]
        at = bounds[rows] - base
        for k in range(_HASHES):
            out[rows, k] = np.minimum.reduceat((part * _MULTIPLIERS[k]) >> np.uint64(32), at)
        lo = hi
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ... compared values: fewest matches at which the posterior stays at the tolerance.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, _HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


class _Block:
    """Members of one side of a comparison."""

    def __init__(self, ids, copies, signatures, sets):
        self.ids, self.copies, self.signatures, self.sets = ids, copies, signatures, sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.bands = np.ascontiguousarray(signatures).view(np.dtype((np.void, 4 * ROWS))).reshape(len(ids), BANDS)


def links(a: _Block, b: _Block, same: bool, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE):
    """Yields arrays (i, j) of the verified links between members of a and b; i < j if both are the same block."""
    least = least_matches(float(threshold), tolerance)
    num, den = threshold.numerator, threshold.denominator
    numbers = None
    width = max(1, (1 << 20) // max(1, len(b.ids)))
    # bands as numbers: equal bytes, equal number
    _, coded = np.unique(np.concatenate((a.bands, b.bands)).reshape(-1), return_inverse=True)
    coded = coded.reshape(-1, BANDS)
    codes_a, codes_b = coded[: len(a.ids)], coded[len(a.ids) :]
    for lo in range(0, len(a.ids), width):
        rows = slice(lo, min(lo + width, len(a.ids)))
        near = np.zeros((rows.stop - lo, len(b.ids)), dtype=bool)
        for k in range(BANDS):
            near |= codes_a[rows, k, None] == codes_b[None, :, k]
        small, large = np.minimum(a.sizes[rows, None], b.sizes[None, :]), np.maximum(a.sizes[rows, None], b.sizes[None, :])
        near &= small * den >= large * num
        if same:
            near &= np.arange(lo, rows.stop)[:, None] < np.arange(len(b.ids))[None, :]
        i, j = np.nonzero(near)
        i += lo
        matches = np.zeros(len(i), dtype=np.int64)
        for step, fewest in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            matches += (a.signatures[i, part] == b.signatures[j, part]).sum(axis=1)
            alive = matches >= fewest
            i, j, matches = i[alive], j[alive], matches[alive]
        if not len(i):
            continue
        if numbers is None:  # shingles as small numbers, so that sets can be marks in an array
            numbers = np.unique(np.concatenate([*a.sets, *b.sets]))
            ids_a = [np.searchsorted(numbers, s) for s in a.sets]
            ids_b = ids_a if same else [np.searchsorted(numbers, s) for s in b.sets]
            marks = np.zeros(len(numbers), dtype=np.int32)
        shared = np.empty(len(i), dtype=np.int64)
        cut = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        for s, e in zip(cut, [*cut[1:], len(i)], strict=True):
            marks[ids_a[i[s]]] = 1
            others = [ids_b[x] for x in j[s:e]]
            at = np.concatenate(([0], np.cumsum([len(x) for x in others])[:-1]))
            shared[s:e] = np.add.reduceat(marks[np.concatenate(others)], at)
            marks[ids_a[i[s]]] = 0
        ok = shared * den >= (a.sizes[i] + b.sizes[j] - shared) * num
        yield i[ok], j[ok]


def _compared(threshold: Fraction, tolerance: float):
    def group(members: list) -> list[tuple]:
        """Rows (kind, a, b, n) of one pair of blocks: kind 0, an edge of the spanning forest; 1, a links to n documents."""
        sides = {}
        lo, hi = members[0][1], members[0][2]
        seen = set()
        for block, cid, copies, signature, shingles in (m[3:] for m in members):
            if cid not in seen:  # a representative whose row repeats comes several times
                seen.add(cid)
                sides.setdefault(block, []).append((cid, copies, signature, shingles))
        if lo not in sides or hi not in sides:
            return []
        built = {k: _Block(np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.stack([np.frombuffer(x[2], np.uint32) for x in v]), [x[3] for x in v]) for k, v in sides.items()}
        a, b = built[lo], built[hi]
        count = {lo: np.zeros(len(a.ids), np.int64), hi: np.zeros(len(b.ids), np.int64)}
        parent: dict[int, int] = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in links(a, b, lo == hi, threshold, tolerance):
            np.add.at(count[lo], i, b.copies[j])
            np.add.at(count[hi], j, a.copies[i])
            for x, y in zip(a.ids[i].tolist(), b.ids[j].tolist(), strict=True):
                p, q = top(x), top(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((0, x, y, 0))
        for k in {lo, hi}:
            out += [(1, int(built[k].ids[x]), 0, int(count[k][x])) for x in np.flatnonzero(count[k])]
        return out

    def run(batches):
        held, key, ready = [], None, []
        schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        for batch in (part for whole in batches for part in T.slices(whole, "text")):
            grams, bounds = shingle_sets(batch.column("text"))
            columns = [batch.column(c).to_pylist() for c in ("root", "lo", "hi", "block", "cid", "copies", "sig")]
            for r, row in enumerate(zip(*columns, strict=True)):
                if row[:3] != key:
                    if held:
                        ready += group(held)
                    held, key = [], row[:3]
                held.append((*row, grams[bounds[r] : bounds[r + 1]].copy()))
            if len(ready) > 5000:
                yield batch_of(ready)
                ready = []
        if held:
            ready += group(held)
        if ready:
            yield batch_of(ready)

    return run


def set_sums(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([np.uint64(0)], np.cumsum(T.mix(grams))))
    return total[bounds[1:]] - total[bounds[:-1]]


def _signed(batches):
    for batch in (part for whole in batches for part in T.slices(whole, "text")):
        grams, bounds = shingle_sets(batch.column("text"))
        sizes = np.diff(bounds)
        values = minhashes(grams, bounds)
        # 128 bits tell sets apart: sums over the hashes of two independent functions
        one, two = (set_sums(*x).view(np.int64) for x in ((grams, bounds), shingle_sets(batch.column("text"), seed=1)))
        sig = pa.array([v.tobytes() if n else None for v, n in zip(values, sizes, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("d"), batch.column("row_hash"), pa.array(one), pa.array(two), pa.array(sizes.astype(np.int64)), sig], names=["d", "row_hash", "set1", "set2", "size", "sig"]
        )


def jaccard_classes(docs: DataFrame, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """For each row of docs(doc_id, text): d (the id, null last), row_hash (of the text), n_links (documents of similarity at
    least the threshold, copies too), class_d and class_hash (d and row_hash of the first document of its class).
    """
    spark = docs.sparkSession
    keyed = docs.select(ordered_id().alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), "text")
    signed = saved(keyed.mapInArrow(_signed, "d long, row_hash long, set1 long, set2 long, size long, sig binary"))
    classes = signed.where("size > 0").groupBy("set1", "set2").agg(F.min(F.struct("d", "row_hash")).alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()))
    bands = classes.select("cid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * 4 * ROWS + 1, F.lit(4 * ROWS))))).alias("bucket"))
    hubs = bands.groupBy("bucket").agg(F.min("cid").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = bands.join(hubs, "bucket").select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    groups = saved(connected_components(stars))
    members = groups.join(classes.select(F.col("cid").alias("node"), "rep.d", "rep.row_hash", "copies", "size", "sig"), "node")
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    members = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("lo"), F.greatest("block", x).alias("hi")))
    texts = members.join(keyed, ["d", "row_hash"]).select("root", F.explode(pairs).alias("p"), "block", F.col("node").alias("cid"), "copies", "sig", "text")
    texts = texts.select("root", "p.lo", "p.hi", "block", "cid", "copies", "sig", "text")
    by = ["root", "lo", "hi"]
    found = saved(texts.repartition(shuffle_partitions(spark), *by).sortWithinPartitions(*by, "block").mapInArrow(_compared(threshold, tolerance), "kind byte, a long, b long, n long"))
    near = connected_components(found.where("kind = 0").select("a", "b"))
    near = near.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    near = near.join(near.groupBy("root").agg(F.min("rep").alias("first")), "root").select(F.col("node").alias("cid"), "first")
    counts = found.where("kind = 1").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    known = classes.join(near, "cid", "left").join(counts, "cid", "left").select("set1", "set2", F.coalesce("first", "rep").alias("first"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    with_words = signed.where("size > 0").select("d", "row_hash", "set1", "set2").join(known, ["set1", "set2"])
    alone = signed.where("size = 0").select("d", "row_hash", F.lit(0).cast("long").alias("n_links"), F.col("d").alias("class_d"), F.col("row_hash").alias("class_hash"))
    return with_words.select("d", "row_hash", "n_links", F.col("first.d").alias("class_d"), F.col("first.row_hash").alias("class_hash")).unionByName(alone)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs, same columns, with one document of each class: the one of smallest id. Documents without words all stay."""
    # a class's first document is named once for each row of its text: rows that repeat are one document
    first = jaccard_classes(docs).where("d = class_d and row_hash = class_hash").select("d", "row_hash").distinct()
    marked = packed(docs).withColumns({"d": ordered_id(), "row_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = marked.join(first, ["d", "row_hash"], "left_semi")
    return unpacked(kept.dropDuplicates(["d", "row_hash"]), docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class of near copies), n_links (documents it links to) of every document."""
    found = jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.nullif("d", F.lit(LAST_ID)).alias("doc_id"), F.nullif("class_d", F.lit(LAST_ID)).alias("class_id"), "n_links")


OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)) + 1)) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {THRESHOLD.denominator} * c >= {THRESHOLD.numerator} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node),
c AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node), k AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.links, 0) AS n_links FROM d LEFT JOIN c ON c.node = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
