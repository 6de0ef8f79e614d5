"""Vectorised word scanning over UTF-8 Arrow string columns, shared by the Arrow-batched operators.

Every separator class used here is a set of ASCII bytes, so words can be found on the UTF-8 bytes:
bytes of multi-byte characters are never separators and never change by ASCII lower-casing.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Words of `[^\\x20\\x09-\\x0D]+`: separators are the ASCII white-space characters.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing: separators are ASCII but for 0-9, A-Z, a-z.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:0x80] = True
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    NOT_ALNUM[_lo:_hi] = False

#: Terms of letters, `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`: separators are ASCII but for A-Z, a-z.
NOT_LETTER = NOT_ALNUM.copy()
NOT_LETTER[0x30:0x3A] = True

#: ASCII lower-casing by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 entries).

    Text bounds cut words, so a word never spans two rows.
    """
    n = len(raw)
    inside = ~separators[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = inside[cuts]
    stop[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def numbered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, the same for the same bytes and for no others, and the distinct words in that order."""
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return column.indices.to_numpy().astype(np.int32), column.dictionary


#: The first rows of the table that `hashes` adds up.
_POSITIONS = 32
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _entries(position: np.ndarray, byte: np.ndarray, seed: int) -> np.ndarray:
    """The table's entry of a byte at a position: 64 bits that look random and hang on both."""
    key = (position.astype(np.uint64) << np.uint64(8)) | byte
    return mix(mix(key + np.uint64(_SEEDS[seed])) + np.uint64(_SEEDS[1 - seed]))


_TABLES = [_entries(np.arange(_POSITIONS, dtype=np.uint64)[:, None], LOWER.astype(np.uint64)[None, :], seed).ravel() for seed in range(2)]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each byte span, ASCII case ignored: equal spans have equal hashes. seed: 0 or 1, two independent functions.

    The sum, mod 2^64, of one random number for each position and byte (tabulation hashing): spans that differ collide as random numbers
    do, whatever their structure. Works through the bytes in blocks that end between spans, so extra memory stays small.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + block, side="right")))
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        if e[-1] > block:  # one long span: piece by piece
            pieces = ((at, raw[base + at : base + min(at + block, e[-1])]) for at in range(0, int(e[-1]), block))
            out[lo] = functools.reduce(np.add, (_entries(np.arange(at, at + len(x)), LOWER[x].astype(np.uint64), seed).sum(dtype=np.uint64) for at, x in pieces))
            lo = hi
            continue
        part = raw[base : base + e[-1]]
        first = np.zeros(len(part), dtype=np.int64)
        first[s[1:]] = np.diff(s)
        position = np.arange(len(part)) - np.cumsum(first)  # behind a span it runs on: those bytes aren't summed
        if (e - s).max(initial=0) <= _POSITIONS:
            near = np.minimum(position, _POSITIONS - 1)
            values = _TABLES[seed][(near << 8) | part]
        else:
            values = _entries(position, LOWER[part].astype(np.uint64), seed)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values, out=total[1:])
        out[lo:hi] = total[e] - total[s]
        lo = hi
    return mix(out)


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive words of one text, and the n + 1 bounds of each text's hashes.

    A text of fewer than k words, but at least one, has one gram of all its words.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(first[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    end = np.repeat(first[1:], n)
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        i = at + j
        ok = i < end
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(ok, h[np.minimum(i, len(h) - 1)], np.uint64(j + 1)) if len(h) else out
    return mix(out), bounds


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Successive parts of a batch whose texts have about `most` bytes at most; a longer text is a part of its own."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    up = np.cumsum(lengths)
    lo = 0
    while lo < len(up):
        base = up[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(up, base + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    pa.default_memory_pool().release_unused()
