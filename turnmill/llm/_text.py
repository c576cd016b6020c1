"""Vectorised text kernel: words, hashes and offsets straight from Arrow's UTF-8 buffers.

A word is a maximal run of ASCII letters, digits and underscores and of any
non-ASCII bytes. ASCII and Latin-1 letters are case-folded without changing the
byte length, so offsets stay valid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[95] = True
_WORD[128:] = True
_MUL = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a hash is usable."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    large = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    if len(arr) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; a longer text comes alone."""
    raw, off = utf8(arr)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``mask`` over each text; 0 for an empty one."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def fold(b: np.ndarray) -> np.ndarray:
    """Lower case of the same length."""
    f = _FOLD[b]
    if len(b) > 1:
        nxt = b[1:]
        m = (b[:-1] == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)
        f[1:][m] += 0x20
    return f


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the maximal runs of ``inside``, which never cross texts."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~cut[:n]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after &= ~cut[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hash_runs(f: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of each run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    idx = np.flatnonzero(inside)
    pos = np.arange(len(idx)) - np.repeat(first, lens)
    v = _MUL[pos & 255]
    v *= f[idx].astype(np.uint64) + np.uint64(1)
    return mix64(np.add.reduceat(v, first) ^ lens.astype(np.uint64))


class Words:
    """The words of a chunk: starts, ends, doc (number of its text) and hash."""

    __slots__ = ("folded", "starts", "ends", "doc", "hash")

    def __init__(self, b: np.ndarray, off: np.ndarray):
        self.folded = fold(b)
        inside = _WORD[self.folded]
        self.starts, self.ends, self.doc = runs(inside, off)
        self.hash = hash_runs(self.folded, inside, self.starts, self.ends)


def doc_terms(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, 44-bit term) of a chunk with counts, ordered by doc; a chunk has fewer than 2^20 texts."""
    key = (doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    key.sort()
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return (key[at] >> np.uint64(44)).astype(np.int64), key[at] & np.uint64((1 << 44) - 1), np.diff(np.append(at, len(key)))
