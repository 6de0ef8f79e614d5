"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are words (runs of non-white-space, A-Z lower-cased) and one end for each text. The root of the tree is the
smoothed unigram distribution; deeper nodes are contexts of one to `DEPTH` preceding tokens (a text begins after a start mark).

1. All training tokens are counted; N tokens, V distinct.
2. Level by level, continuations (context, next token) are counted over all training texts. One is explicit if it occurs
   `MIN_COUNT` times, whatever the size of the corpus. Contexts and suffixes that can't reach that are left out before the shuffle by a
   table of bits of bounded size; it may let others through, which the count then drops. So are contexts whose shorter context always goes on
   with the same token: they can gain less than 1 in log-likelihood over it, and never pass the test.
3. A context is retained if its distribution diverges from its parent's by more than it costs to describe:
   the gain in log-likelihood of its occurrences must exceed log(N) / 2 for each explicit continuation.
4. P(w | s) = (n(s, w) + (n(s) - explicit + 1) P(w | parent of s)) / (n(s) + 1), with n(s, w) of explicit continuations only:
   what a context has not seen often goes to its parent. A token is scored by its longest retained context.

Contexts and continuations are written tables. In log10 a score is a sum: the unigram of each token, what each retained context
backs off, and what each explicit continuation adds to that. So each is a value of the hash of its tokens, and can be joined to the texts
by that alone. The most frequent `CACHE_ENTRIES` of them are broadcast and added where the text is read: a cache of fixed size that
changes no score. The rest are asked for: keys that a table of bits lets through go, packed by ranges of hashes, where the entries go, and
sums come back to each group of texts.

Null and empty texts are one end. Rows of null id are training texts. Without training texts all scores are 0.
"""

from __future__ import annotations

import functools
import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import BATCH_BYTES, release, saved, shuffle_partitions, table

CACHE_ENTRIES = 2_500_000
MIN_COUNT, DEPTH = 2, 4
MU = 1.0
#: Rows that a task counts together, rows that it holds before it sends them on, and bytes of text to a part of the merge.
CHUNK_ROWS, SENT_ROWS, PART_BYTES = 1_000_000, 500_000, 6_000_000
#: Entries to a part of scoring, texts to a group (their numbers have 16 bits), and tasks that answer at most.
PART_ENTRIES, GROUP_TEXTS, ANSWERING = 250_000, 1 << 16, 64
#: Parts of small inputs.
LEAST_PARTS = 32

_START, _END = (T.mix(np.array([i], dtype=np.uint64))[0] for i in (101, 202))
_FIRST, _SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def sequence(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each after a start mark and before its end; the n + 1 bounds of the texts."""
    raw, offsets = T.utf8(column)
    starts, ends, first = T.words(raw, offsets, T.SPACE)
    n = len(first) - 1
    out = np.empty(len(starts) + 2 * n, dtype=np.uint64)
    bounds = first + 2 * np.arange(n + 1)
    out[bounds[:-1]] = _START
    out[bounds[1:] - 1] = _END
    out[np.arange(len(starts)) + 2 * np.repeat(np.arange(n), np.diff(first)) + 1] = T.hashes(raw, starts, ends)
    return out, bounds


def extended(context: np.ndarray, token: np.ndarray, level: int) -> np.ndarray:
    """The hash of a context with a token behind it."""
    return T.mix(context * (_FIRST if level == 1 else _SECOND) + token)


class _Found:
    """Values by hash, looked up where the first bits of a hash say they begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(8, len(keys).bit_length()))
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is, -1 if nowhere."""
        out = np.full(len(h), -1, dtype=np.int32)
        bucket = h >> self.shift
        at, end = self.first[bucket], self.first[bucket + np.uint64(1)]
        left = np.flatnonzero(at < end)
        at, end, h = at[left], end[left], h[left]
        while len(left):
            hit = self.keys[at] == h
            out[left[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            left, at, end, h = left[on], at[on] + 1, end[on], h[on]
        return out


class Tree:
    """What is broadcast: frequent tokens with their counts, frequent entries with what they add to a score.

    rest: the table (key, value, known) of all other entries and tokens; bits: which keys may be an entry, frequent or not.
    """

    def __init__(self, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.z = total + 0.5 * (distinct + 1)
        self.tokens, self.entries, self.least = _Found(np.zeros(0, np.uint64), np.zeros(0, np.int64)), _Found(np.zeros(0, np.uint64), np.zeros(0)), MIN_COUNT
        #: What frequent tokens add to a score themselves, and as contexts of one token.
        self.logs, self.backs = np.zeros(0), np.zeros(0)
        self.rest, self.bits = None, Bits()
        #: While it grows, by length: which explicit continuations and which contexts that more than one token follows there may be.
        self.explicit: dict[int, Bits] = {}
        self.open: dict[int, Bits] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rest"}

    @property
    def counts(self) -> np.ndarray:
        """Of frequent tokens."""
        return self.tokens.values

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / self.z


def _starts(*arrays: np.ndarray) -> np.ndarray:
    """Where in parallel arrays a row differs from the one before."""
    new = np.ones(len(arrays[0]), dtype=bool)
    if len(new):
        new[1:] = functools.reduce(np.logical_or, [a[1:] != a[:-1] for a in arrays])
    return np.flatnonzero(new)


def _summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(key)
    key = key[order]
    at = _starts(key)
    return key[at], np.add.reduceat(values[order], at) if len(at) else values[:0]


#: What goes between Python tasks: for each range of hashes, and sender, one row with many packed rows of a kind. Few rows, and no room lost in the shuffle.
_PACKED = "part int, kind int, k long, blob binary"
_COUNT, _ASK, _TOTAL, _PARENT, _ROW, _ENTRY, _OWN, _KEY = range(8)


def _packed(part: list, kind: int, k: list, blobs: list):
    """Arrow batches of some MB of packed rows."""
    whole = pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array(k, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "kind", "k", "blob"])
    step = max(1, len(part) * BATCH_BYTES // (1 + whole.nbytes))
    yield from (whole.slice(i, step) for i in range(0, len(part), step))


def _cuts(h: np.ndarray, parts: int) -> np.ndarray:
    """Where in sorted hashes each of `parts` equal ranges of them begins, and the end."""
    return np.searchsorted((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


class _Sender:
    """Holds parallel arrays of 64 bits, the first a hash, and packs them by ranges of it, SENT_ROWS at a time."""

    def __init__(self, kind: int, parts: int):
        self.kind, self.parts, self.held, self.size = kind, parts, [], 0

    def add(self, *arrays: np.ndarray):
        if len(arrays[0]):
            self.held.append([a.view(np.uint64) for a in arrays])
            self.size += len(arrays[0])
        if self.size > SENT_ROWS:
            yield from self.rest()

    def rest(self):
        if self.size:
            arrays = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            order = np.argsort(arrays[0])
            cut = _cuts(arrays[0][order], self.parts).tolist()
            arrays = np.stack([a[order] for a in arrays])
            full = [p for p in range(self.parts) if cut[p] < cut[p + 1]]
            yield from _packed(full, self.kind, [cut[p + 1] - cut[p] for p in full], [arrays[:, cut[p] : cut[p + 1]].tobytes() for p in full])
        self.held, self.size = [], 0


def _by_part(batches):
    """Each part of rows sorted by part, with its (k, blob) by kind; one part is held at a time."""
    now, held = None, {}
    for batch in batches:
        for part, kind, k, blob in zip(*(batch.column(x).to_pylist() for x in ("part", "kind", "k", "blob")), strict=True):
            if part != now and held:
                yield now, held
                held = {}
            now = part
            held.setdefault(kind, []).append((k, blob))
    if held:
        yield now, held


def _unpacked(rows: list, width: int) -> np.ndarray:
    """The arrays that a _Sender has packed."""
    return np.concatenate([np.frombuffer(blob, np.uint64).reshape(width, -1) for _, blob in rows] or [np.zeros((width, 0), np.uint64)], axis=1)


def _met(rows: DataFrame, run, schema: str = _PACKED, tasks: int = 0) -> DataFrame:
    """run on all rows of each part together."""
    return rows.repartition(tasks or shuffle_partitions(rows.sparkSession), "part").sortWithinPartitions("part").mapInArrow(run, schema)


def _sending(kind: int, parts: int, columns: list[str], probes: int = 1):
    """Rows to what a _Sender packs of their columns, the first a hash. probes: at 2 its lower half is sent too, as `Bits` asks for it."""

    def run(batches):
        sender = _Sender(kind, parts)
        for batch in batches:
            arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            yield from sender.add(*arrays)
            if probes == 2:
                yield from sender.add(arrays[0] << 32)
        yield from sender.rest()

    return run


#: In place of a suffix that can't be explicit: only its context's total counts it.
_NONE = np.uint64(0)


def _counting(level: int, parts: int, shared: _Shared | None = None):
    """Arrow batches of texts to packed counts of (context, suffix), CHUNK_ROWS at a time.

    A context is named once for all that follows it, with how often it occurs. Ranges are of the contexts' hashes; at level 1, where
    one word may be in all texts, each context is dealt out to eight by its suffixes.
    """
    of = _grams(level, shared)

    def emit(held):
        context, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        h = context & np.uint64(0xFFFFFFFF00000000) | extended(context, suffix, 1) >> np.uint64(32)
        if level == 1:
            h = h >> np.uint64(3) | suffix & np.uint64(7 << 61)
        order = np.argsort(h)
        context, suffix, h = context[order], suffix[order], h[order]
        at = _starts(context, suffix)
        n = np.diff(np.append(at, len(h))).astype(np.uint32)
        context, suffix, h = context[at], suffix[at], h[at]
        first = _starts(context, h >> np.uint64(32))
        real = suffix != _NONE
        totals, follow = (np.add.reduceat(x, first, dtype=np.uint32) for x in (n, real))
        cut, inner = _cuts(h[first], parts).tolist(), _cuts(h[real], parts).tolist()
        context, suffix, n = context[first], suffix[real], n[real]
        full = [p for p in range(parts) if cut[p] < cut[p + 1]]
        blobs = [b"".join(x[c[p] : c[p + 1]].tobytes() for x, c in ((context, cut), (suffix, inner), (totals, cut), (follow, cut), (n, inner))) for p in full]
        yield from _packed(full, _COUNT, [cut[p + 1] - cut[p] for p in full], blobs)

    def run(batches):
        held, size = [], 0
        for batch in (part for whole in batches for part in T.slices(whole, "text")):
            held.append(of(*sequence(batch.column("text"))))
            size += len(held[-1][0])
            if size > CHUNK_ROWS:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return run


def _merging(level: int, parts: int):
    """Counts to asks of (suffix, context, n) for what occurs MIN_COUNT times, and totals of contexts; at level 1 of all."""

    def run(batches):
        asks, totals = _Sender(_ASK, parts), _Sender(_TOTAL, parts)
        for _, held in _by_part(batches):
            read = []
            for k, blob in held[_COUNT]:
                r = (len(blob) - 16 * k) // 12
                wide, narrow = np.frombuffer(blob, np.uint64, k + r), np.frombuffer(blob, np.uint32, offset=8 * (k + r))
                read.append((wide[:k], wide[k:], narrow[:k], narrow[k : 2 * k], narrow[2 * k :]))
            context, suffix, total, follow, n = (np.concatenate(x) for x in zip(*read, strict=True))
            del read
            of = np.repeat(context, follow)
            order = np.argsort(extended(of, suffix, 1))
            of, suffix, n = of[order], suffix[order], n[order].astype(np.uint64)
            at = _starts(of, suffix)
            n = np.add.reduceat(n, at) if len(at) else n
            keep = n >= MIN_COUNT
            of, suffix, n = of[at[keep]], suffix[at[keep]], n[keep]
            context, total = _summed(context, total.astype(np.uint64))
            if level > 1:
                asked = total >= MIN_COUNT
                asked[asked] = np.isin(context[asked], of)
                context, total = context[asked], total[asked]
            yield from asks.add(suffix, of, n)
            yield from totals.add(context, total)
        yield from asks.rest()
        yield from totals.rest()

    return run


def _token_counts(batches):
    """Totals of contexts of one token to counts of tokens: each is followed by something but the end, and that is as often as the start."""
    for _, held in _by_part(batches):
        token, n = _summed(*_unpacked(held[_TOTAL], 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(token == _START, _END, token).view(np.int64)), pa.array(n.view(np.int64))], names=["token", "n"])


def _meeting_parents(parts: int):
    """Asks and parents of a part to rows (context, token, n, p)."""

    def run(batches):
        out = _Sender(_ROW, parts)
        for _, held in _by_part(batches):
            suffix, context, n = _unpacked(held.get(_ASK, []), 3)
            key, token, p = _unpacked(held.get(_PARENT, []), 3)
            if not len(key) or not len(suffix):
                continue
            order = np.argsort(key)
            key, token, p = key[order], token[order], p[order]
            at = np.minimum(np.searchsorted(key, suffix), len(key) - 1)
            found = key[at] == suffix
            at = at[found]
            yield from out.add(context[found], token[at], n[found], p[at])
        yield from out.rest()

    return run


_TESTED = "context long, token long, n long, p double, value double, open boolean"


def _testing(total: int):
    """Rows and totals of a part's contexts to _TESTED: a row for each continuation, with its p here, and one without a token for each context.

    value: what it adds to a score, null if its context fails the divergence test.
    """

    def run(batches):
        for _, held in _by_part(batches):
            context, token, n, p = _unpacked(held.get(_ROW, []), 4)
            if not len(context):
                continue
            order = np.argsort(context)
            context, token, n, p = context[order], token[order], n[order].astype(float), p.view(float)[order]
            at = _starts(context)
            siblings = np.diff(np.append(at, len(context)))
            own_key, m = _summed(*_unpacked(held[_TOTAL], 2))
            m = m[np.searchsorted(own_key, context[at])].astype(float)
            known = np.add.reduceat(n, at)
            back = m - known + MU
            of = np.repeat(np.arange(len(at)), siblings)
            own = (n + back[of] * p) / (m + MU)[of]
            gain = np.add.reduceat(n * np.log(own / p), at) + (m - known) * np.log(back / (m + MU))
            kept = gain > 0.5 * np.log(total) * siblings
            of_rows = [context.view(np.int64), n.astype(np.int64), np.where(kept[of], own, p), np.where(kept[of], np.log10(1 + n / (back[of] * p)), np.nan)]
            of_contexts = [context[at].view(np.int64), m.astype(np.int64), np.zeros(len(at)), np.where(kept, np.log10(back / (m + MU)), np.nan)]
            key, n, p, value = (np.concatenate(x) for x in zip(of_rows, of_contexts, strict=True))
            tokens = pa.concat_arrays([pa.array(token.view(np.int64)), pa.nulls(len(at), pa.int64())])
            opens = pa.concat_arrays([pa.nulls(len(of), pa.bool_()), pa.array((siblings > 1) | (known < m))])
            whole = pa.RecordBatch.from_arrays([pa.array(key), tokens, pa.array(n), pa.array(p), pa.array(value, from_pandas=True), opens], names=["context", "token", "n", "p", "value", "open"])
            yield from (whole.slice(i, 1 << 16) for i in range(0, whole.num_rows, 1 << 16))

    return run


def _depths(n: int, bounds: np.ndarray) -> np.ndarray:
    """For each of the sequence, how many of its text are before it, the start mark included."""
    return np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))


def _grams(level: int, shared: _Shared | None = None):
    """Continuations as (context, suffix): hashes of `level` tokens, the suffix one token further on, _NONE if it can't be explicit.

    Of contexts that matter all occurrences are given. A context may have been left out as a continuation, because what its last token follows
    always goes on with that token; then it occurs as often as the context without that token.
    """

    def of(seq, bounds):
        tree = shared.broadcast.value if shared else None
        grams = [seq, seq]  # by length, from 1
        for j in range(1, level):
            grams.append(np.concatenate((grams[-1][:1], extended(grams[-1][:-1], seq[1:], j))))
        context, suffix = grams[level][:-1], grams[level][1:]
        ok = _depths(len(seq), bounds)[1:] >= level
        if level == 1:
            return context[ok], suffix[ok]

        def alive(j, at):
            """Whether what ends at these positions may be explicit, as the last of `j` tokens."""
            own = np.ones(len(at), dtype=bool) if j == 2 else tree.open[j - 2](grams[j - 2][at - 1])
            out = np.zeros(len(at), dtype=bool)
            out[own] = tree.explicit[j - 1](grams[j][at[own]])
            if j > 2:
                out[~own] = alive(j - 1, at[~own] - 1)
            return out

        at = np.flatnonzero(ok)
        at = at[tree.open[level - 1](grams[level - 1][at])]
        at = at[alive(level, at)]
        suffix = suffix[at]
        return context[at], np.where(tree.explicit[level - 1](suffix), suffix, _NONE)

    return of


class Bits:
    """A table of bits that says which hashes may be in a set: some eight bits a member, at most 2 ** most; beyond that it says yes more often, never no in error.

    probes: bits that tell a hash, one or two.
    """

    PARTS = 32

    def __init__(self, keys: DataFrame | None = None, most: int = 28, probes: int = 1):
        self.probes, self.size = probes, 0
        self.bytes = np.zeros(0, dtype=np.uint8)
        if keys is not None:
            self.size = min(most, max(18, (8 * keys.count()).bit_length()))
            self.bytes = np.zeros(1 << (self.size - 3), dtype=np.uint8)
            sent = keys.mapInArrow(_sending(_KEY, self.PARTS, ["key"], probes), _PACKED)
            for batch in _met(sent, self._set(self.size)).select("part", "blob").toArrow().to_batches():
                for part, bits in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                    self.bytes[part * len(bits) : (part + 1) * len(bits)] = np.frombuffer(bits, np.uint8)

    @classmethod
    def _set(cls, size: int):
        def run(batches):
            for part, held in _by_part(batches):
                bits = np.zeros((1 << size) // cls.PARTS, dtype=bool)
                bits[(_unpacked(held[_KEY], 1)[0] >> np.uint64(64 - size)) % np.uint64(len(bits))] = True
                yield from _packed([part], _KEY, [0], [np.packbits(bits, bitorder="little").tobytes()])

        return run

    def __getstate__(self) -> tuple:
        return self.probes, self.size, zlib.compress(self.bytes, 1)

    def __setstate__(self, state: tuple) -> None:
        self.probes, self.size = state[:2]
        self.bytes = np.frombuffer(zlib.decompress(state[2]), np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.bytes):
            return np.zeros(len(h), dtype=bool)
        out = self._at(h)
        if self.probes == 2:
            out[out] = self._at(h[out] << np.uint64(32))
        return out

    def _at(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.size)
        return (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


class _Shared:
    def __init__(self, spark: SparkSession, tree: Tree):
        self.broadcast = spark.sparkContext.broadcast(tree)


def _swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """Adds the key of context and token, as `extended` has it, to rows. Products and sums wrap, so the columns are resolved without ANSI mode."""
    conf = rows.sparkSession.conf
    long = lambda x: F.lit(int(np.uint64(x).view(np.int64)))
    x, ansi = F.col("key"), conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        rows = rows.withColumn("key", F.col("context") * long(_FIRST if level == 1 else _SECOND) + F.col("token"))
        rows = rows.withColumn("key", x.bitwiseXOR(F.shiftrightunsigned(x, 30)) * long(0xBF58476D1CE4E5B9))
        rows = rows.withColumn("key", x.bitwiseXOR(F.shiftrightunsigned(x, 27)) * long(0x94D049BB133111EB))
        return rows.withColumn("key", x.bitwiseXOR(F.shiftrightunsigned(x, 31)))
    finally:
        conf.set("spark.sql.ansi.enabled", ansi)


def _level(texts: DataFrame, level: int, parts: int, shared: _Shared | None = None) -> DataFrame:
    """The written table of packed asks and totals of the contexts of `level` tokens."""
    return saved(_met(texts.mapInArrow(_counting(level, parts, shared), _PACKED), _merging(level, parts)))


def learn(docs: DataFrame, cache_entries: int = CACHE_ENTRIES) -> tuple[Tree, DataFrame]:
    """The tree of docs(text), and the table (token, n) of all token counts. Scores don't depend on cache_entries."""
    spark = docs.sparkSession
    texts = docs.select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, size // PART_BYTES)
    counted = _level(texts, 1, parts)
    tokens = saved(_met(counted.where(F.col("kind") == _TOTAL), _token_counts, "token long, n long"))
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = Tree(total, distinct)
    if not total:
        return tree, tokens
    explicit = tokens.where(F.col("n") >= MIN_COUNT)
    parents = explicit.select(F.col("token").alias("key"), "token", ((F.col("n") + 0.5) / F.lit(float(tree.z))).alias("p"))
    start, end = (int(np.array(x).view(np.int64)) for x in (_START, _END))
    totals = explicit.select(F.when(F.col("token") == end, F.lit(start)).otherwise(F.col("token")).alias("context"), "n").mapInArrow(_sending(_TOTAL, parts, ["context", "n"]), _PACKED)
    entries, before = [], None
    for level in range(1, DEPTH + 1):
        if level > 1:
            shared = _Shared(spark, tree)
            counted = _level(texts, level, parts, shared)
            shared.broadcast.destroy()  # what it was read for is written
            totals = counted.where(F.col("kind") == _TOTAL)
        _swept(spark)
        asked = counted.where(F.col("kind") == _ASK).union(parents.mapInArrow(_sending(_PARENT, parts, ["key", "token", "p"]), _PACKED))
        rows = _met(_met(asked, _meeting_parents(parts)).union(totals), _testing(total), _TESTED)
        rows = saved(_keyed(rows, level).withColumn("key", F.coalesce("key", "context")).drop("context"))
        release(counted)
        if level > 2:
            release(before)
        before = rows
        _swept(spark)
        retained = rows.where("value IS NOT NULL").select("key", "n", "value")
        entries.append(saved(retained) if level > 1 else retained)  # at the first level most are retained: no second copy
        # a parent that failed the test itself has its own parent's distribution
        parents = rows.where("token IS NOT NULL").select("key", "token", "p")
        if level < DEPTH:
            tree.explicit[level], tree.open[level] = Bits(parents.select("key")), Bits(rows.where("open").select("key"))
    release(before)
    tree.explicit, tree.open = {}, {}
    known = functools.reduce(DataFrame.union, entries)
    least = tree.least = _least(known.select("n").union(tokens.select("n")), cache_entries)
    often = tokens.where(F.col("n") >= least).toArrow()  # cache_entries bounds both
    tree.tokens = _Found(often["token"].to_numpy().view(np.uint64), often["n"].to_numpy())
    often = known.where(F.col("n") >= least).select("key", "value").toArrow()
    keys, at = np.unique(often["key"].to_numpy().view(np.uint64), return_inverse=True)
    tree.entries = _Found(keys, np.bincount(at, often["value"].to_numpy(), len(keys)))  # a context and a continuation of the same tokens add up
    tree.logs = np.log10(tree.unigram(tree.counts))
    at = tree.entries(tree.tokens.keys)  # a context of one token occurs as often as the token
    tree.backs = np.where(at >= 0, np.append(tree.entries.values, 0.0)[at], 0.0)
    del often, keys, at
    rare = tokens.where(F.col("n") < least).select(F.bitwise_not("token").alias("key"), F.log10((F.col("n") + 0.5) / 0.5).alias("value"), F.lit(1.0).alias("known"))
    tree.rest = rare.union(known.where(F.col("n") < least).select("key", "value", F.lit(0.0)))
    tree.bits = Bits(tree.rest.select("key").union(known.where(F.col("n") >= least).select("key")), 30, 2)
    _swept(spark)
    return tree, tokens


def _least(counts: DataFrame, most: int) -> int:
    """The lowest count, doubled from MIN_COUNT, that at most `most` rows of counts(n) reach."""
    powers = [MIN_COUNT << i for i in range(50)]
    above = counts.agg(*[F.count(F.when(F.col("n") >= p, 1)) for p in powers]).first()
    return next((p for p, n in zip(powers, above, strict=True) if n <= most), powers[-1])


#: A token's own count goes by another key than what it backs off as a context: its complement.
_OWN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def _asking(shared: _Shared, parts: int):
    """Texts to what they are without the rest of the tree, packed as one _OWN for some thousand texts, and what they ask of the rest.

    An ask is a key, and the number of the text that asks; `k` numbers the group of texts.
    """

    def emit(group, own, keys, texts):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _OWN_SCHEMA) as writer:
            for batch in own:
                writer.write_batch(batch)
        yield from _packed([group % parts], _OWN, [group], [sink.getvalue().to_pybytes()])
        keys, texts = np.concatenate(keys), np.concatenate(texts)
        order = np.argsort(keys)
        keys, texts = keys[order], texts[order]
        cut = _cuts(keys, parts).tolist()
        full = [p for p in range(parts) if cut[p] < cut[p + 1]]
        yield from _packed(full, _ASK, [group] * len(full), [keys[cut[p] : cut[p + 1]].tobytes() + texts[cut[p] : cut[p + 1]].tobytes() for p in full])

    def run(batches):
        tree = shared.broadcast.value
        group = TaskContext.get().partitionId() << 32
        own, keys, texts, size, count = [], [], [], 0, 0
        unseen = np.log10(tree.unigram(0))
        for batch in (part for whole in batches for part in T.slices(whole, "text")):
            for batch in (batch.slice(i, GROUP_TEXTS // 2) for i in range(0, batch.num_rows, GROUP_TEXTS // 2)):
                n = batch.num_rows
                if own and (size > SENT_ROWS or count + n > GROUP_TEXTS):
                    yield from emit(group, own, keys, texts)
                    own, keys, texts, size, count, group = [], [], [], 0, 0, group + 1
                seq, bounds = sequence(batch.column("text"))
                text_of = np.repeat(np.arange(n), np.diff(bounds))
                depth = _depths(len(seq), bounds)
                at = tree.tokens(seq)
                is_token = depth > 0
                frequent = at >= 0
                base, added = np.full(len(seq), unseen), np.zeros(len(seq))
                base[frequent], added[frequent] = tree.logs[at[frequent]], tree.backs[at[frequent]]
                base[bounds[:-1]] = 0.0
                rare = np.flatnonzero(~frequent & is_token)
                rare = rare[tree.bits(~seq[rare])]
                keys.append(~seq[rare])
                of = [rare]
                gram = seq
                for level in range(1, DEPTH + 2):
                    # a frequent token's context is in its row
                    deep = np.flatnonzero(~frequent if level == 1 else depth >= level - 1)
                    deep = deep[tree.bits(gram[deep])]
                    h = gram[deep]
                    at = tree.entries(h)
                    hit = at >= 0
                    added[deep[hit]] += tree.entries.values[at[hit]]
                    keys.append(h[~hit])
                    of.append(deep[~hit])
                    if level <= DEPTH:
                        gram = np.concatenate((gram[:1], extended(gram[:-1], seq[1:], level)))
                of = np.concatenate(of)
                texts.append((count + text_of[of]).astype(np.uint16))
                sums = [np.bincount(text_of, w, minlength=n) for w in (frequent, base, base + added)]
                columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(bounds) - 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
                own.append(pa.RecordBatch.from_arrays(columns, schema=_OWN_SCHEMA))
                size += len(of)
                count += n
        if own:
            yield from emit(group, own, keys, texts)

    return run


def _answering(parts: int):
    """Asks and entries of each part to sums by group of texts: a row for each group and task, of what its texts gain in all, in tokens and in tokens known."""

    def answers(sums):
        for group, held in sums.items():
            yield from _packed([_place(group)], _ENTRY, [group], [held.tobytes()])

    def run(batches):
        sums, size = {}, 0
        for _, held in _by_part(batches):
            for group, blob in held.get(_OWN, []):
                yield from _packed([_place(group)], _OWN, [group], [blob])
            if _ENTRY not in held or _ASK not in held:
                continue
            key, value, known = _unpacked(held[_ENTRY], 3)
            order = np.argsort(key)
            key, value, known = key[order], value.view(float)[order], known.view(float)[order]
            at = _starts(key)
            key, value, known = key[at], np.add.reduceat(value, at), known[at]
            for group, blob in held[_ASK]:
                n = len(blob) // 10
                asked, text = np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint16, offset=8 * n)
                at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
                hit = key[at] == asked
                at, text = at[hit], text[hit]
                if not len(at):
                    continue
                most = int(text.max()) + 1
                own = known[at] > 0
                new = np.stack([np.bincount(text, value[at], most), np.bincount(text[own], value[at[own]], most), np.bincount(text[own], minlength=most).astype(float)])
                old = sums.get(group)
                if old is None or old.shape[1] < most:
                    size += most - (0 if old is None else old.shape[1])
                    if old is not None:
                        new[:, : old.shape[1]] += old
                    sums[group] = new
                else:
                    old[:, :most] += new
            if size > CHUNK_ROWS:
                yield from answers(sums)
                sums, size = {}, 0
        yield from answers(sums)

    return run


def _place(group: int) -> int:
    """The part of a group's answers."""
    return int(T.mix(np.array([group], np.uint64))[0] >> np.uint64(34))


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _adding(batches):
    """Groups of texts with their answers to _SCORED."""
    for _, held in _by_part(batches):
        answers = {}
        for group, blob in held.get(_ENTRY, []):
            answers.setdefault(group, []).append(np.frombuffer(blob, float).reshape(3, -1))
        for group, blob in held[_OWN]:
            own = pa.ipc.open_stream(blob).read_all().combine_chunks()
            known, base, score = (own[c].to_numpy().astype(float) for c in ("known", "base", "score"))
            for more in answers.get(group, []):
                n = more.shape[1]
                score[:n] += more[0]
                base[:n] += more[1]
                known[:n] += more[2]
            columns = [*(own[c].combine_chunks() for c in ("doc_id", "held_out", "n_tokens")), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, tree: Tree, tokens: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of each row of docs(doc_id, text, held_out); tokens are in the tree's rest or broadcast with it."""
    spark = docs.sparkSession
    tasks = shuffle_partitions(spark)
    rest = tree.rest.count() if tree.rest is not None else 0
    parts = max(LEAST_PARTS, rest // PART_ENTRIES)
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), "held_out").mapInArrow(_asking(_Shared(spark, tree), parts), _PACKED)
    if rest:
        rows = rows.union(tree.rest.mapInArrow(_sending(_ENTRY, parts, ["key", "value", "known"]), _PACKED))
    # few tasks answer: each sends on a sum for every text
    return _met(_met(rows, _answering(parts), tasks=min(tasks, ANSWERING)), _adding, _SCORED)


def op3_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    tree, tokens = learn(docs.where("not held_out"))
    scored = score(docs, tree, tokens)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
