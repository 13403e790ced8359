"""Vectorised text work on Arrow buffers: word spans, 64-bit word and n-gram hashes.

Everything here takes whole batches of texts as one byte buffer; no loop runs per word. Batches are cut into
slices of about SLICE_BYTES of whole texts, so memory is bounded by SLICE_BYTES or the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None
U = np.uint64
_M1, _M2, _STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_BYTE = mix((np.arange(1, 257, dtype=U)) * _STEP)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: True for bytes between words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LINES = np.zeros(256, bool)
LINES[0x0A] = True


def trim() -> None:
    """Give free memory back to the system, so that workers that wait for their next task hold little."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            t = np.full(size, U(base))
            t[0] = 1
            _powers[i] = np.cumprod(t, dtype=U)
    return _powers[0], _powers[1]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets): whole texts, together at most limit bytes or a single text. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b
    trim()


class Words:
    """Words of one slice: starts, ends (bytes), doc (row in the slice), and h, their 64-bit hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, between: np.ndarray, lower: bool, hashes: bool = True):
        n = len(buf)
        inside = ~between[buf]
        edge = np.empty(n + 1, bool)
        edge[:-1] = inside
        edge[-1] = False
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        before[offs] = False
        self.starts = np.flatnonzero(edge & ~before)
        after = edge.copy()
        after[offs] = False
        ends = inside & ~after[1:]
        self.ends = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offs, self.starts, "right") - 1
        self.n_docs = len(offs) - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self.h = self._hash(buf, lower) if hashes else None

    def _hash(self, buf: np.ndarray, lower: bool) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U)
        power, inverse = _power_tables(len(buf) + 1)
        c = np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * power[: len(buf)], dtype=U)
        head = np.where(self.starts > 0, c[self.starts - 1], U(0))
        return mix((c[self.ends - 1] - head) * inverse[self.starts] + (self.ends - self.starts).astype(U) * _STEP)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(w: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of k words inside one text."""
    m = len(w.doc) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    start = np.flatnonzero(w.doc[:m] == w.doc[k - 1 :])
    h = np.zeros(m, U)
    for j in range(k):
        h += w.h[j : j + m] * mix(U([seed * 1000 + 2 * j + 1]) * _STEP)[0]
    return start, mix(h[start])


def distinct_by_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by (doc, hash), without repeats."""
    o = np.argsort(h, kind="stable")
    small = doc[o].astype(np.uint16) if len(doc) and doc[-1] < 65536 else doc[o]
    o = o[np.argsort(small, kind="stable")]
    doc, h = doc[o], h[o]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash): each text's distinct k-word shingles; a text of fewer words, but not none, is one shingle."""
    start, h = grams(w, k)
    doc = w.doc[start]
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        x = np.zeros(len(short), U)
        for j in range(k - 1):
            has = counts[short] > j
            x[has] += w.h[w.first[short][has] + j] * mix(U([500_000 + 2 * j]) * _STEP)[0]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(x + counts[short].astype(U))])
        o = np.argsort(doc, kind="stable")
        doc, h = doc[o], h[o]
    return distinct_by_doc(doc, h)


def pack(a: np.ndarray) -> bytes:
    """Integers as byte planes: equal high bytes lie together, which a shuffle's compression then removes."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def unpack(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, its part of each array), the bucket numbers ascending in the input."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(at, np.append(at[1:], len(bucket)), strict=False):
        yield int(bucket[a]), *(x[a:b] for x in arrays)


def rolling(x: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of every k neighbours of x, from running sums."""
    m = len(x) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    power, inverse = _power_tables(len(x) + 1)
    c = np.zeros(len(x) + 1, U)
    np.cumsum(mix(x.astype(U) ^ U(salt)) * power[: len(x)], out=c[1:])
    return mix((c[k:] - c[:-k]) * inverse[:m])
