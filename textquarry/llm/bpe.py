"""Byte-level BPE encoding and decoding by monoid tree reduction.

Two levels of segments form a monoid under concatenation, and both are reduced as balanced trees:

1. Pieces. A text is halved down to leaves of `LEAF_CHARS` characters; a leaf is cut into pieces by the pattern. To join
   neighbours, the last k pieces of the left and the first k of the right are cut anew as one window. Pieces before the
   window stand if at least `LOOK` characters follow them on the left: no match of the pattern looks further. Pieces
   after it stand from the first bound that the window's pieces share with those of the right and that has `LOOK`
   characters behind it in the window: the pattern doesn't look back, so from one bound on both go on alike. Else k doubles.
2. Tokens. A piece of more than `LEAF_BYTES` bytes is halved too; a leaf is merged, lowest rank first, leftmost of equals.
   To join neighbours, the last k tokens of the left and the first k of the right are merged anew as one window, and k
   doubles until each token beside the window forms a stable pair with the window's outermost one. A pair is stable if
   merging its bytes alone gives the pair back. A sequence whose adjacent pairs are all stable is the encoding of its
   bytes: take the first merge of the whole that would cross a bound; up to then each side has gone through the merges it
   goes through in the pair alone, so the pair alone would make that merge too, and it would not be stable.

A piece that is itself a token is that token. Pieces recur, so each Python worker keeps those met lately (`CACHED`, then it starts anew).
Decoding concatenates the bytes of halves up a tree of the same shape.

The vocabulary (a rank file; its size bounds what is broadcast) and the pattern are parameters. Null texts are empty: no ids.
Each row is a text of its own, whatever its id (null ids and repeated rows too); other columns are left out. No rows: no rows.
An id that the vocabulary lacks, or bytes that aren't whole ids, make the decoded value null.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 1 << 14
LEAF_BYTES = 64
#: Characters past a match of the pattern that can bear on it: a contraction has 3 in all, white space looks at the one after the next.
LOOK = 2
#: Pieces kept in each Python worker, and the length of the longest kept.
CACHED, CACHED_CHARS = 200_000, 48


def ranks_of(file: bytes) -> dict[bytes, int]:
    """The tokens of a rank file and their ids."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


def unknown_characters() -> str:
    """Characters that Python's regex module takes for letters or digits and the tokenizer library, of another Unicode version, doesn't.

    All of them are unassigned in Python's own tables, so only those are asked about.
    """
    unassigned = "".join(c for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn")
    single = {bytes([i]): i for i in range(256)}
    library = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]+", mergeable_ranks=single, special_tokens={})
    there = set(bytes(library.encode_ordinary(unassigned)).decode())
    return "".join(c for c in regex.findall(r"[\p{L}\p{N}]", unassigned) if c not in there)


class Codec:
    """Encodes and decodes single texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, unknown: str = "", leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.unknown = frozenset(unknown)
        self.shadow = dict.fromkeys(map(ord, unknown), "\ue000")  # neither letter, digit nor space
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.pairs: dict[tuple[int, int], bool] = {}
        self.table = _Table(self.bytes_of)
        self.kept = _Kept(self)

    def cut(self, text: str) -> list[str]:
        """The pieces of a text, one after the other."""
        if not text.isascii() and not self.unknown.isdisjoint(text):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.shadow))]
        return self.pattern.findall(text)

    # --- tokens of one piece

    def merge(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals, until no pair is a token."""
        return self.merge_short(raw) if len(raw) <= LEAF_BYTES else self.merge_long(raw)

    def merge_short(self, raw: bytes) -> list[int]:
        rank, none = self.ranks.get, len(self.ranks) << 8
        parts = [raw[i : i + 1] for i in range(len(raw))]
        of = [rank(raw[i : i + 2], none) for i in range(len(raw) - 1)]  # of the pair that begins at each part
        while of and (least := min(of)) < none:
            i = of.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del of[i]
            if i:
                of[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(of):
                of[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[x] for x in parts]

    def merge_long(self, raw: bytes) -> list[int]:
        """The same by a heap of pairs, in n log n steps."""
        ranks, end = self.ranks, list(range(1, len(raw) + 1))
        heap = [(rank, i, i + 1, i + 2) for i in range(len(raw) - 1) if (rank := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)  # end[i]: where the part from i ends, 0 once it is gone; start[e]: where the part that ends at e begins
        start = dict(zip(end, range(len(raw)), strict=True))
        while heap:
            _, i, mid, to = heapq.heappop(heap)
            if end[i] != mid or end[mid] != to:
                continue
            end[i], end[mid] = to, 0
            start[to] = i
            if i and (rank := ranks.get(raw[start[i] : to])) is not None:
                heapq.heappush(heap, (rank, start[i], i, to))
            if to < len(raw) and (rank := ranks.get(raw[i : end[to]])) is not None:
                heapq.heappush(heap, (rank, i, to, end[to]))
        out, i = [], 0
        while i < len(raw):
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        pair = self.pairs.get((a, b))
        if pair is None:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            pair = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return pair

    def joined_tokens(self, left: list[int], right: list[int]) -> list[int]:
        k = 1
        while True:
            at = max(0, len(left) - k)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[at:] + right[:k])))
            if (not at or self.stable(left[at - 1], window[0])) and (k >= len(right) or self.stable(window[-1], right[k])):
                return left[:at] + window + right[k:]
            k *= 2

    def tokens(self, raw: bytes) -> list[int]:
        if len(raw) <= self.leaf_bytes:
            return self.merge(raw)
        half = max(1, len(raw) // 2 // self.leaf_bytes) * self.leaf_bytes  # whole leaves: what repeats in a power of 2 is stable at once
        return self.joined_tokens(self.tokens(raw[:half]), self.tokens(raw[half:]))

    # --- pieces of one text

    def joined(self, left: tuple[list, list], right: tuple[list, list]) -> tuple[list, list]:
        """Of two neighbouring texts as (pieces, the ids of each), the same of their concatenation."""
        (before, before_ids), (after, after_ids) = left, right
        k = 2
        while True:
            at = max(0, len(before) - k)
            own = "".join(before[at:])
            window = own + "".join(after[:k])
            if not at or len(own) >= LOOK:
                pieces, most = self.cut(window), len(window) if k >= len(after) else len(window) - LOOK
                bounds = dict(zip(itertools.accumulate(map(len, after[:k]), initial=len(own)), range(k + 1), strict=False))
                for n, x in enumerate(itertools.accumulate(map(len, pieces)), 1):
                    if x > most:
                        break
                    if (rest := bounds.get(x)) is not None:
                        return before[:at] + pieces[:n] + after[rest:], before_ids[:at] + list(map(self.kept.__getitem__, pieces[:n])) + after_ids[rest:]
            k *= 2

    def pieces(self, text: str) -> tuple[list, list]:
        if len(text) <= self.leaf_chars:
            cut = self.cut(text)
            return cut, list(map(self.kept.__getitem__, cut))
        half = len(text) // 2
        return self.joined(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode(self, text: str) -> bytes:
        """The ids, packed."""
        return b"".join(self.pieces(text)[1])

    def decode(self, ids: np.ndarray) -> bytes:
        """IndexError: an id is no token."""
        if len(ids) <= self.leaf_chars:
            return self.table.of(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Table:
    """The bytes of all tokens in one array."""

    def __init__(self, bytes_of: dict[int, bytes]):
        top = max(bytes_of, default=-1) + 1
        self.bytes = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.size = np.array([len(bytes_of.get(i, b"")) for i in range(top)], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        if not size.all():
            raise IndexError("no token")
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class _Kept(dict):
    """The packed ids of pieces met lately."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.codec.ranks.get(raw)
        ids = np.array([whole] if whole is not None else self.codec.tokens(raw), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


def _vocabulary(spark: SparkSession, path: str | None):
    """The rank file in a broadcast: executors need no copy of the file."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


@functools.lru_cache(2)
def _codec(file: bytes, pattern: str = public_tokenizers.PATTERN, unknown: str = "") -> Codec:
    """One for all tasks of a Python worker: pieces met in one are known in the next."""
    return Codec(ranks_of(file), pattern, unknown)


def encoded(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids (packed, 4 bytes little-endian each; see `unpacked_ids`) of each row of docs(doc_id, text).

    path: of a rank file on the driver; by default that of `VOCABULARY`.
    """
    vocabulary, unknown = _vocabulary(docs.sparkSession, path), unknown_characters()

    def run(batches):
        codec = _codec(vocabulary.value, pattern, unknown)
        for batch in (part for whole in batches for part in T.slices(whole, "text")):
            ids = [codec.encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def unpacked_ids(ids: str = "ids"):
    """Packed ids as an array of integers."""
    byte = lambda i: F.conv(F.hex(F.substring(ids, i, 1)), 16, 10).cast("long")
    at = F.sequence(F.lit(0), (F.octet_length(ids) / 4 - 1).cast("int"))
    return F.when(F.octet_length(ids) < 4, F.array().cast("array<long>")).otherwise(F.transform(at, lambda i: byte(i * 4 + 1) + byte(i * 4 + 2) * (1 << 8) + byte(i * 4 + 3) * (1 << 16) + byte(i * 4 + 4) * (1 << 24)))


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ids(doc_id, n_tokens, ids) with decoded: the bytes that the ids stand for."""
    vocabulary = _vocabulary(ids.sparkSession, path)

    def bytes_of(codec: Codec, packed: bytes | None) -> bytes | None:
        if packed is None or len(packed) % 4:
            return None
        try:
            return codec.decode(np.frombuffer(packed, "<u4"))
        except IndexError:
            return None

    def run(batches):
        codec = _codec(vocabulary.value)
        for batch in (part for whole in batches for part in T.slices(whole, "ids")):
            out = pa.array([bytes_of(codec, x) for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=["doc_id", "n_tokens", "ids", "decoded"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: its whole text encoded, and the ids decoded again."""
    both = decoded(encoded(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
