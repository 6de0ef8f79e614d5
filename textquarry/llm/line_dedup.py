"""Line dedup: range-sorted line hashes, first occurrences streamed, compressed keep bitmaps out.

1. Each text is cut at line feeds. A line's key (white space stripped at both ends, A-Z lower-cased) is hashed
   to 128 bits by BLAKE2, so that no two keys are known to collide; keys under `min_chars` code points take no part.
2. The hashes are range-partitioned and sorted by (hash, document, position). A hash that fills more than one
   partition is cut between them by document, so no key, however frequent, lands in one task.
3. Each sorted partition is streamed. The first document of a run of equal hashes keeps its lines, all others of
   the run are dropped. Only a partition's first run can have begun in an earlier one: its lines are settled
   against the last runs of all partitions, one row for each partition.
4. The dropped positions of a document become a bitmap (bit 1: keep), packed and compressed with zlib.

Null ids count as one document after all others. Two rows of the same id are one document: a key's lines are all
kept in the smallest id, however often they repeat there. Null and empty texts are one empty line.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import ordered_id, packed, saved, shuffle_partitions, table, unpacked

MIN_CHARS = 10
_LOWER = bytes(T.LOWER)


def _line_hashes(min_chars: int):
    newline = np.zeros(256, dtype=bool)
    newline[0x0A] = True

    def run(batches):
        for batch in (part for whole in batches for part in T.slices(whole, "text")):
            ids = batch.column("d").to_numpy(zero_copy_only=False)
            marks = batch.column("row_hash").to_numpy(zero_copy_only=False)
            raw, offsets = T.utf8(batch.column("text"))
            starts, ends, _ = T.words(raw, offsets, T.SPACE)
            if not len(starts):
                continue
            feeds = np.flatnonzero(raw == 0x0A)
            # the line of a word: line feeds before it in its own text
            text_of = np.searchsorted(offsets, starts, side="right") - 1
            feeds_before = np.searchsorted(feeds, starts)
            position = feeds_before - np.searchsorted(feeds, offsets[text_of])
            new = np.ones(len(starts), dtype=bool)
            new[1:] = (text_of[1:] != text_of[:-1]) | (position[1:] != position[:-1])
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(starts)])) - 1
            s, e, of, at = starts[first], ends[last], text_of[first], position[first]
            points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            long = points[e] - points[s] >= min_chars
            s, e, of, at = s[long], e[long], of[long], at[long]
            low = raw.tobytes().translate(_LOWER)
            digests = b"".join([hashlib.blake2b(low[i:j], digest_size=16).digest() for i, j in zip(s.tolist(), e.tolist(), strict=True)])
            keys = np.frombuffer(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]),
                    pa.array(ids[of]),
                    pa.array(marks[of]),
                    pa.array(at.astype(np.int32)),
                ],
                names=["h1", "h2", "d", "row_hash", "pos"],
            )

    return run


def _first_occurrences(batches):
    """Streams a partition sorted by (h1, h2, d, pos); emits dropped lines, undecided lines and the last run's first document.

    kind 0: a dropped line; 1: a line of the partition's first run, with the first document of that run here;
    2: one row, the last run.
    """
    h1 = h2 = first_doc = None
    head = True

    def rows(kind, a, b, d, r, p, f):
        n = len(d)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8)), pa.array(a), pa.array(b), pa.array(d), pa.array(r), pa.array(p), pa.array(f)],
            names=["kind", "h1", "h2", "d", "row_hash", "pos", "first_doc"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, d, r, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if h1 is not None:
            new[0] = a[0] != h1 or b[0] != h2
        run = np.cumsum(new)
        at = np.flatnonzero(new)
        firsts = np.concatenate(([first_doc if first_doc is not None else 0], d[at]))
        f = firsts[run]
        was_head = head and h1 is not None
        in_head = (run == 0) if was_head else (run <= 1) if h1 is None else np.zeros(len(a), bool)
        drop = (d != f) & ~in_head
        if drop.any():
            yield rows(0, a[drop], b[drop], d[drop], r[drop], p[drop], f[drop])
        if in_head.any():
            yield rows(1, a[in_head], b[in_head], d[in_head], r[in_head], p[in_head], f[in_head])
        head = bool(in_head[-1])
        h1, h2, first_doc = a[-1], b[-1], f[-1]
    if h1 is not None:
        one = np.zeros(1, np.int64)
        yield rows(2, np.array([h1]), np.array([h2]), np.array([first_doc]), one, one.astype(np.int32), np.array([first_doc]))


def _bitmaps(batches):
    for batch in batches:
        keeps = []
        for positions in batch.column("dropped").to_pylist():
            bits = np.ones((max(positions) // 8 + 1) * 8, dtype=bool)
            bits[positions] = False
            keeps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("row_hash"), pa.array(keeps, pa.binary())], names=["d", "row_hash", "keep"])


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with d, the id with null last, and row_hash, which tells apart rows of one id with different texts."""
    return docs.withColumns({"d": ordered_id(id_col), "row_hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Keep bitmaps (d, row_hash, keep) of the documents that lose lines; see `with_keys` for d and row_hash.

    keep: zlib-compressed little-endian bits by line, 1 to keep; lines past its end, and all of documents without
    a row here, are kept.
    """
    spark = docs.sparkSession
    rows = docs.select(ordered_id(id_col).alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash"), F.col(text_col).alias("text"))
    lines = saved(rows.mapInArrow(_line_hashes(min_chars), "h1 long, h2 long, d long, row_hash long, pos int"))
    order = ["h1", "h2", "d", "pos"]
    streamed = lines.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(
        _first_occurrences, "kind byte, h1 long, h2 long, d long, row_hash long, pos int, first_doc long"
    )
    found = saved(streamed)
    # one row for each partition at most, whatever the input: broadcast
    ends = F.broadcast(found.where("kind = 2").groupBy("h1", "h2").agg(F.min("first_doc").alias("earlier")))
    open_runs = found.where("kind = 1").join(ends, ["h1", "h2"], "left").where("d <> least(first_doc, coalesce(earlier, first_doc))")
    dropped = found.where("kind = 0").select("d", "row_hash", "pos").unionByName(open_runs.select("d", "row_hash", "pos"))
    return dropped.groupBy("d", "row_hash").agg(F.collect_list("pos").alias("dropped")).mapInArrow(_bitmaps, "d long, row_hash long, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """The text without its dropped lines; lines before; lines dropped."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    kept = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def keep_bitmaps_joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with d, row_hash and keep (null: all lines stay)."""
    return with_keys(docs, id_col, text_col).join(line_dedup(docs, id_col, text_col, min_chars), ["d", "row_hash"], "left")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, keep_emptied: bool = True) -> DataFrame:
    """docs(doc_id, text, ...), same columns, with the dropped lines taken out of the texts; texts that lose none stay as they are, null too.

    keep_emptied=False leaves out documents that lose lines and have nothing but white space left.
    """
    rows = packed(docs)
    schema = rows.schema

    def run(batches):
        for batch in batches:
            texts = [t if k is None else kept_lines(t, k)[0] for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, batch.column("text").type), batch.column("rest")], names=schema.names)
            if not keep_emptied:
                out = out.filter(pa.array([k is None or bool(t.strip(" \t\n\x0b\x0c\r")) for t, k in zip(texts, batch.column("keep").to_pylist(), strict=True)]))
            yield out

    return unpacked(keep_bitmaps_joined(rows, min_chars=min_chars).select(*schema.names, "keep").mapInArrow(run, schema), docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""

    def digest(batches):
        for batch in batches:
            out = [kept_lines(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.int64()),
                    pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in out], pa.string()),
                ],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return keep_bitmaps_joined(docs).select("doc_id", "text", "keep").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP6_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.doc_id, k.line, k.pos, coalesce(f.n >= 2 AND f.first_doc <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN firsts f ON f.key = k.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
