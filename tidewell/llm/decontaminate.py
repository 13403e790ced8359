"""Benchmark decontamination by suffix arrays over shards of the training texts.

A shard is a slice of whole documents. Its suffix array holds, in order, every word suffix at which a benchmark window
could begin, that is, at which enough words in a row belong to the benchmark's vocabulary; suffixes are compared as far
as the longest item reaches. Every suffix of every item (that still holds a window) is binary-searched in each shard's
array: the common prefixes with both neighbours give its longest verbatim match there and the place of it, and the
range of suffixes that share its window (13 words; a shorter item is one window) gives all occurrences. A document's
own longest match comes the same way, by searching its hit suffixes in the suffix array of the items.

The benchmark is sent to the workers in blocks of at most BLOCK_BYTES of text (an array of 4 bytes for each word and its
order; no Python object for each word); there are as many passes as blocks. Documents are never shuffled.

Defined results: null or empty texts have no words and are clean; items without words match nothing; items with
the same text all count; items without an item_id hit words but aren't listed; an empty benchmark hits nothing; rows that
repeat are judged alike; other columns of docs may have any names and stay as they are. Of equally long matches of a
document the first one counts, and of the items that hold it the one whose item_id is least as a string.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import runtime

WINDOW = 13
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20


def suffix_order(x: np.ndarray, run: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts (ascending) in the order of the suffixes x[s : s + run[s]], as far as depth words; equal ones by place.

    Two words at a time; only suffixes that are still equal to another are looked at again.
    """
    order = starts.copy()
    group, tied, off = np.zeros(len(order), np.int64), np.arange(len(order)), 0
    last = len(x) - 1
    while len(tied) and off < depth:
        p = order[tied]
        a, b = (np.where(run[p] > off + i, x[np.minimum(p + off + i, last)], 0).astype(np.uint64) for i in (0, 1))
        key = a << np.uint64(32) | b
        own = group[tied]
        o = np.lexsort((key, own)) if off else np.argsort(key, kind="stable")
        order[tied], key, own, open_ = p[o], key[o], own[o], b[o] > 0
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(key))
        group[tied] = np.repeat(tied[first], size)
        tied = tied[np.repeat(size > 1, size) & open_]
        off += 2
    return order


def common(x: np.ndarray, run: np.ndarray, p: np.ndarray, y: np.ndarray, y_run: np.ndarray, q: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Words that the suffixes p of x and q of y have in common, pair by pair, most at most."""
    n = np.minimum(run[p], y_run[q])
    n = n if most is None else np.minimum(n, most)
    out, at, off = np.zeros(len(n), np.int64), np.flatnonzero(n > 0), 0
    while len(at):
        at = at[x[p[at] + off] == y[q[at] + off]]
        off += 1
        out[at] = off
        at = at[n[at] > off]
    return out


def locate(x: np.ndarray, run: np.ndarray, order: np.ndarray, y: np.ndarray, y_run: np.ndarray, q: np.ndarray, most: np.ndarray | None = None, right: bool = False) -> np.ndarray:
    """Binary search: where the suffixes q of y (their first most words) belong in order, before or (right) behind those they begin."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
    whole = y_run[q] if most is None else np.minimum(y_run[q], most)
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        p, own = order[mid], q[open_]
        k = common(x, run, p, y, y_run, own, whole[open_])
        ended = k == whole[open_]
        have = np.where(run[p] > k, x[np.minimum(p + k, len(x) - 1)], 0)
        want = y[np.minimum(own + k, len(y) - 1)]
        behind = np.where(ended, right, have < want)
        lo[open_] = np.where(behind, mid + 1, lo[open_])
        hi[open_] = np.where(behind, hi[open_], mid)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def _runs(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words from each place to the next 0 or the end of its text (ends: true at a text's last word)."""
    n = len(x)
    stop = np.flatnonzero((x == 0) | ends)
    nxt = stop[np.searchsorted(stop, np.arange(n))] if n else np.zeros(0, np.int64)
    return np.where(x > 0, nxt - np.arange(n) + (x[nxt] > 0), 0)


class Items:
    """A block of benchmark items: their words as ids, their suffix array, and the items of each distinct window."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        texts = pa.array([t or "" for _, t in items], pa.string())
        self.names = [None if i is None else str(i) for i, _ in items]
        hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, _, buf, offs in K.slices(texts):
            w = K.Words(buf, offs, K.NOT_ALNUM, True)
            hashes.append(w.h)
            owner.append(w.doc + a)
        h, self.owner = np.concatenate(hashes), np.concatenate(owner)
        self.words, at = np.unique(h, return_inverse=True)
        self.x = (at + 1).astype(np.uint32)
        n = len(self.x)
        self.first = np.searchsorted(self.owner, np.arange(len(items) + 1))
        self.run = self.first[self.owner + 1] - np.arange(n) if n else np.zeros(0, np.int64)
        self.depth = int(self.run.max()) if n else 0
        self.order = suffix_order(self.x, self.run, np.arange(n), self.depth)
        need = np.minimum(window, np.diff(self.first))[self.owner]
        #: Suffixes that hold a window, in their order, and the windows' sizes.
        self.suffixes = self.order[self.run[self.order] >= need[self.order]]
        self.need = need[self.suffixes]
        self.least = int(self.need.min()) if len(self.need) else 0
        # equal windows lie side by side: the common prefix with the neighbour tells
        q = self.suffixes
        new = np.ones(len(q), bool)
        if len(q) > 1:
            new[1:] = (self.need[1:] != self.need[:-1]) | (common(self.x, self.run, q[:-1], self.x, self.run, q[1:], self.need[1:]) < self.need[1:])
        self.window = np.cumsum(new) - 1
        self.head = np.flatnonzero(new)
        pair = np.unique(np.stack([self.window, self.owner[q]], 1), axis=0) if len(q) else np.zeros((0, 2), np.int64)
        self.holders, self.holder_at = pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(self.head) + 1))


class Shard:
    """A slice of documents with the suffix array that a block of items is searched in."""

    def __init__(self, items: Items, buf: np.ndarray, offs: np.ndarray):
        self.items, self.w = items, K.Words(buf, offs, K.NOT_ALNUM, True)
        w, n = self.w, len(self.w.doc)
        if not n or not items.least:
            self.x, self.run, self.order = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        at = np.minimum(np.searchsorted(items.words, w.h), len(items.words) - 1)
        self.x = np.where(items.words[at] == w.h, at + 1, 0).astype(np.uint32)
        self.run = _runs(self.x, np.append(w.doc[1:] != w.doc[:-1], True))
        self.order = suffix_order(self.x, self.run, np.flatnonzero(self.run >= items.least), items.depth)

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every suffix of items.suffixes: the words of its longest match in the shard, and the word where that begins (-1: none)."""
        t, q = self.items, self.items.suffixes
        if not len(self.order):
            return np.zeros(len(q), np.int64), np.full(len(q), -1)
        at = locate(self.x, self.run, self.order, t.x, t.run, q)
        near = [np.clip(at - k, 0, len(self.order) - 1) for k in (0, 1)]
        size = [common(self.x, self.run, self.order[k], t.x, t.run, q) for k in near]
        best = np.where(size[0] >= size[1], near[0], near[1])
        size = np.maximum(*size)
        return size, np.where(size > 0, self.order[best], -1)

    def occurrences(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct window, word at which it occurs), all of them; size: what longest() gives."""
        t = self.items
        found = t.head[size[t.head] >= t.need[t.head]] if len(size) else t.head[:0]
        q, most = t.suffixes[found], t.need[found]
        lo, hi = (locate(self.x, self.run, self.order, t.x, t.run, q, most, right) for right in (False, True))
        count = hi - lo
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return np.repeat(t.window[found], count), self.order[place]

    def statistics(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the document suffixes pos: the words of the longest match with any item, and its place in items.order."""
        t = self.items
        at = locate(t.x, t.run, t.order, self.x, self.run, pos)
        near = [np.clip(at - k, 0, len(t.order) - 1) for k in (0, 1)]
        size = [common(t.x, t.run, t.order[k], self.x, self.run, pos) for k in near]
        return np.maximum(*size), np.where(size[0] >= size[1], near[0], near[1])

    def holder(self, place: int, size: int) -> tuple[str | None, int]:
        """The least item_id, and the place in that item, among the items that share size words with the item suffix at place."""
        t = self.items
        q, most = t.order[[place]], np.array([size])
        lo, hi = (int(locate(t.x, t.run, t.order, t.x, t.run, q, most, right)[0]) for right in (False, True))
        same = t.order[lo:hi]
        return min(((t.names[i], int(j - t.first[i])) for i, j in zip(t.owner[same], same, strict=True)), key=lambda r: (r[0] is None, r[0] or "", r[1]))


class Found:
    """What a pass found in a shard, joined with what earlier passes left: hit words, items and longest match of each text."""

    def __init__(self, shard: Shard, earlier: list[list] | None):
        t, w = shard.items, shard.w
        self.w = w
        size, _ = shard.longest()
        which, pos = shard.occurrences(size)
        change = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(change, pos, 1)
        np.add.at(change, pos + t.need[t.head[which]], -1)
        self.hit = np.cumsum(change[:-1]) > 0
        self.items: list[set] = [set() for _ in range(w.n_docs)]
        pair = np.unique(np.stack([w.doc[pos], which], 1), axis=0)
        for d, k in pair.tolist():
            self.items[d].update(t.names[i] for i in t.holders[t.holder_at[k] : t.holder_at[k + 1]] if t.names[i] is not None)
        #: words, start, item and place in the item of the longest match; (0, -1, None, -1): none
        self.best: list[tuple] = [(0, -1, None, -1)] * w.n_docs
        pos = np.unique(pos)
        if len(pos):
            n, place = shard.statistics(pos)
            doc = w.doc[pos]
            o = np.lexsort((pos, -n, doc))
            for k in o[np.unique(doc[o], return_index=True)[1]]:
                self.best[doc[k]] = (int(n[k]), int(pos[k] - w.first[doc[k]]), *shard.holder(int(place[k]), int(n[k])))
        if earlier:
            for row, (mask, own, *best) in enumerate(zip(*earlier, strict=True)):
                if mask is not None:
                    a, b = w.first[row], w.first[row + 1]
                    self.hit[a:b] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
                    self.items[row].update(own)
                    self.best[row] = min(self.best[row], tuple(best), key=lambda r: (-r[0], r[1], r[2] is None, r[2] or "", r[3]))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        total = np.concatenate([[0], np.cumsum(self.hit)])
        return self.w.counts(), total[self.w.first[1:]] - total[self.w.first[:-1]]


def _blocks(benchmark: DataFrame, block_bytes: int):
    b = benchmark.select("item_id", "text")
    size = b.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    if n == 1:
        yield True, [tuple(r) for r in b.collect()]
        return
    split = b.withColumn("k", F.expr(f"pmod(xxhash64(item_id, text), {n})"))
    for k in range(n):
        yield k == n - 1, [tuple(r) for r in split.where(F.col("k") == k).select("item_id", "text").collect()]


_DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_start long, longest_item string, longest_item_start long"
#: What a pass leaves for the next one, behind the columns of the documents.
_CARRIED = [T.StructField("mask", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("item", T.StringType()), T.StructField("at", T.LongType())]
_BEST = (pa.int64(), pa.int64(), pa.string(), pa.int64())


def _best_arrays(f: Found) -> list[pa.Array]:
    return [pa.array([b[k] for b in f.best], t) for k, t in enumerate(_BEST)]


def _digest(batch: pa.RecordBatch, f: Found) -> pa.RecordBatch:
    n, hit = f.counts()
    own = [sorted(x) for x in f.items]
    sha = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in own], pa.string())
    cols = [batch.column(0), pa.array(n), pa.array(hit), pa.array([len(x) for x in own], pa.int64()), sha, pa.array((hit > 0) & (20 * hit >= n)), *_best_arrays(f)]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _DIGEST.split(", ")])


def _clean(batch: pa.RecordBatch, f: Found) -> pa.RecordBatch:
    n, hit = f.counts()
    return batch.filter(pa.array(~((hit > 0) & (20 * hit >= n))))


def _carry(batch: pa.RecordBatch, f: Found) -> pa.RecordBatch:
    own = [f.hit[a:b] for a, b in zip(f.w.first, f.w.first[1:], strict=False)]
    masks = pa.array([np.packbits(x).tobytes() if x.any() else None for x in own], pa.binary())
    return pa.RecordBatch.from_arrays([*batch.columns, masks, pa.array([sorted(x) for x in f.items], pa.list_(pa.string())), *_best_arrays(f)], names=[f"c{i}" for i in range(batch.num_columns + len(_CARRIED))])


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, last_step, schema) -> DataFrame:
    spark = docs.sparkSession
    runtime.ship(spark)
    columns, at = docs.schema, docs.columns.index("text")
    width = len(columns)

    def scan(shared, step):
        def run(batches):
            for batch in batches:
                for a, b, buf, offs in K.slices(batch.column(at), SHARD_BYTES):
                    part = batch.slice(a, b - a)
                    earlier = [c.to_pylist() for c in part.columns[width:]]
                    own = pa.RecordBatch.from_arrays(part.columns[:width], names=part.schema.names[:width])
                    yield step(own, Found(Shard(shared.value, buf, offs), earlier))

        return run

    # columns go by place between the passes, so that no name of docs can clash
    more = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*columns.fields, *_CARRIED])])
    for last, items in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Items(items, window))
        if last:
            return docs.mapInArrow(scan(shared, last_step), schema)
        docs = runtime.cut(docs.mapInArrow(scan(shared, _carry), more), "hits")
    raise AssertionError("there is always a block")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest verbatim match with an item of each row of docs.

    longest_words (0: none), longest_start (place in the document, -1: none), longest_item (its item_id) and
    longest_item_start (place in the item).
    """
    return _passes(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window, block_bytes, _digest, _DIGEST)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated (a twentieth of the words or more hit), with all their columns."""

    def clean(batch, found):
        return pa.RecordBatch.from_arrays(_clean(batch, found).columns, names=names)

    names = docs.columns
    return _passes(docs, benchmark, window, block_bytes, clean, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id (as a string), item_start, words, doc_id, doc_start: for every item suffix that occurs by a window or more, its longest verbatim match in all documents.

    Of equally long matches one is given. Each shard answers for itself; the best per suffix is taken before and after the shuffle.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def scan(shared):
        def run(batches):
            t = shared.value
            for batch in batches:
                for a, b, buf, offs in K.slices(batch.column(1), SHARD_BYTES):
                    shard = Shard(t, buf, offs)
                    size, at = shard.longest()
                    k = np.flatnonzero(size >= t.need)
                    q, p = t.suffixes[k], at[k]
                    doc = shard.w.doc[p]
                    names = pa.array([t.names[i] for i in t.owner[q]], pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(q - t.first[t.owner[q]]), pa.array(size[k]), batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(p - shard.w.first[doc])], names=["item_id", "item_start", "words", "doc_id", "doc_start"])

        return run

    out = None
    for _, items in _blocks(benchmark, block_bytes):
        found = docs.mapInArrow(scan(spark.sparkContext.broadcast(Items(items, window))), "item_id string, item_start long, words long, doc_id long, doc_start long")
        out = found if out is None else out.union(found)
    best = F.max_by(F.struct("words", "doc_id", "doc_start"), F.struct("words", -F.col("doc_id"), -F.col("doc_start"))).alias("m")
    return out.groupBy("item_id", "item_start").agg(best).select("item_id", "item_start", "m.*")
