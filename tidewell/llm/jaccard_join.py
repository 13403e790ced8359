"""N-gram Jaccard join: a metric-space join over sets of word shingles, as connected components.

Jaccard distance is a metric. Two texts link when 100 * |intersection| >= percent * |union|, so within a distance
eps = 1 - percent / 100. Almost all documents of a corpus are at distance 1 from almost all others, where pivots
can't tell them apart; so the space is first split exactly, and pivots find the links inside its parts:

1. Regions. The universe of shingles is dealt by hash to a number of cells that is larger than the greatest symmetric
   difference of two linked sets of about this size; so two linked sets agree exactly in some cell that isn't empty, and
   share its signature (the hash of all their shingles in that cell). A signature's documents are joined in a star to
   the smallest, never in pairs, and what is connected is a region. A signature stands for several shingles that lie
   anywhere in the text, and shingles that a sample finds common sign last, so regions hold near copies rather than texts
   with a common passage. No count or sketch of the corpus decides anything. (See Signatures for empty cells.)
2. Pivots inside a region: the members go to the Voronoi cells of far-apart pivots, and to every other cell whose
   pivot is within 2 * eps of their nearest (triangle inequality), so a linked pair meets in a cell; cells are
   joined recursively. Members within eps of a pivot are linked through it. Where cells don't shrink (dense groups), every
   member outside the largest component becomes a pivot in turn, against those that the triangle inequality leaves. No
   other comparison is made, also in a region of two.
3. A region beyond REGION_ROWS or REGION_SHINGLES isn't given to one task: it is split once more by common rare shingles
   (of the region's own counts), and then the same steps as in 2 are taken over a table, its members in parts of
   LARGE_PART rows, its pivots sent to each part, until its cells fit or don't shrink any more.

Equal sets are one point, whatever their number; every comparison counts exact set sizes of 64-bit shingle hashes.

Defined results: null or empty text and text without words have n_shingles 0 and link with nothing, as do rows
without a doc_id (component_id null); rows that repeat a doc_id are one node and share its links; the result has
one row per input row, an empty table none; other columns of docs aren't read.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import runtime

#: Bounds of what one task joins; larger regions are joined as tables, with the same result.
REGION_ROWS = 500
REGION_SHINGLES = 4_000_000
#: Rows of a large region that meet its pivots in one task.
LARGE_PART = 200
PIVOTS = 8
#: Documents for each bucket of the signature exchange.
BUCKET_DOCS = 1500
#: Dealings of the universe before single shingles are used.
DEALINGS = 4
#: Shingles in SEEN or more of a sample of one document in SAMPLE are common; MOST_COMMON of them at most (8 bytes each) are told to the workers.
SAMPLE, SEEN, MOST_COMMON = 64, 4, 500_000


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


class Signatures:
    """Signatures of sets of which two linked ones always share one.

    Sizes are split into classes that grow by a quarter, so linked sets lie in one class or in neighbours; a set signs for
    its own class and, if a linked set can be larger than that, for the next one. In class c, linked sets differ in at most
    differ(c) shingles, so of cells(c) cells at least cells(c) - differ(c) agree. A set with fewer empty cells than that
    shares a cell that isn't empty with every linked set. A set with as many or more (few sets, by chance) signs for another
    dealing too, DEALINGS times at most, and at last by single shingles: the n - ceil(n * percent / 100) + 1 of least
    hash, one of which every linked set of its kind has as well. Where both of a pair have too many empty cells both sign
    further, else one of them is enough.

    The first dealing leaves out common shingles, whatever set of them is given: without them two sets differ in no more
    shingles than with them. So what many documents have in common signs only for sets that have little else.
    """

    def __init__(self, percent: int, common: np.ndarray | None = None):
        self.percent, self.most, self.common = percent, [0, 1], common

    def top(self, c: int) -> int:
        while len(self.most) <= c:
            m = self.most[-1]
            self.most.append(max(m + 1, m * 5 // 4, 100 * m // self.percent))
        return self.most[c]

    def classes(self, n: np.ndarray) -> np.ndarray:
        while self.most[-1] < (n.max() if len(n) else 0):
            self.top(len(self.most))
        return np.searchsorted(self.most, n)

    def differ(self, c: int) -> int:
        return 2 * self.top(c) * (100 - self.percent) // (100 + self.percent)

    @lru_cache(maxsize=None)  # noqa: B019
    def cells(self, c: int) -> int:
        """Enough that a set of the least size that signs in the class seldom has too many empty cells."""
        h, low = self.differ(c), (self.top(c - 1) if c else 0) * self.percent // 100 + 1
        k = h + 1
        while h and k < 2 * h + 4:
            empty = k * math.exp(-low / k)
            if empty + 2 * math.sqrt(empty) < k - h:
                break
            k += 1 + h // 100
        return k if h else 1

    def sign(self, doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc, signature) of sets (doc ascending, its shingle hashes, sizes of all docs)."""
        docs, sigs = [], []
        own = self.classes(n)
        usual = np.isin(h, self.common) if self.common is not None and len(self.common) else np.zeros(len(h), bool)
        tops = np.array([self.top(c) for c in range(int(own.max()) + 2)]) if len(own) else np.zeros(0, np.int64)
        for step in (0, 1):
            at = np.flatnonzero((n > 0) & ((step == 0) | (100 * n // self.percent > tops[own]) if len(own) else False))
            c = own[at] + step
            for salt in range(DEALINGS):
                if not len(at):
                    break
                cells = np.array([self.cells(int(x)) for x in range(int(c.max()) + 1)])[c]
                spare = cells - np.array([self.differ(int(x)) for x in range(int(c.max()) + 1)])[c]
                first = np.cumsum(cells) - cells
                where = np.full(len(n), -1)
                where[at] = np.arange(len(at))
                of = where[doc]
                mine = of >= 0
                if not salt:
                    mine &= ~usual
                x, of = K.mix(h[mine] ^ K.U(0x9D5C + salt)), of[mine]
                slot = first[of] + ((x >> K.U(32)) * cells[of].astype(np.uint64) >> K.U(32)).astype(np.int64)
                total = np.zeros(int(cells.sum()), np.uint64)
                np.add.at(total, slot, K.mix(x))
                full = np.zeros(len(total), bool)
                full[slot] = True
                owner = np.repeat(np.arange(len(at)), cells)
                number = np.arange(len(total)) - first[owner]
                tag = K.mix((c[owner].astype(np.uint64) << K.U(40)) ^ (number.astype(np.uint64) << K.U(4)) ^ K.U(salt))
                docs.append(at[owner[full]])
                sigs.append(K.mix(total[full] ^ tag[full]))
                empty = np.bincount(owner[~full], minlength=len(at))
                again = empty >= spare
                at, c = at[again], c[again]
            if len(at):
                d, x = self._single(doc, h, n, at, c)
                docs.append(d)
                sigs.append(x)
        return (np.concatenate(docs), np.concatenate(sigs)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def _single(self, doc, h, n, at, c):
        kind = np.full(len(n), -1)
        kind[at] = c
        mine = kind[doc] >= 0
        d, x = doc[mine], K.mix(h[mine] ^ K.U(0x51))
        o = np.lexsort((x, d))
        d, x = d[o], x[o]
        size = np.bincount(d, minlength=len(n))
        rank = np.arange(len(d)) - (np.cumsum(size) - size)[d]
        keep = rank <= (n - _needed(n, self.percent))[d]
        d, x = d[keep], x[keep]
        return d, K.mix(x ^ (kind[d].astype(np.uint64) << K.U(40)) ^ K.U(0xFFFF))


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up


class Region:
    """Sets in rows (flat elements and offsets): links all that are within the distance, as components."""

    def __init__(self, flat: np.ndarray, offs: np.ndarray, percent: int):
        vocab, self.flat = np.unique(flat, return_inverse=True)
        self.offs, self.percent, self.n = offs, percent, np.diff(offs)
        self.eps = 1 - percent / 100 + 1e-9
        self.mark = np.zeros(len(vocab), np.int64)
        self.union = _Union(len(offs) - 1)
        self.pivots = self.cells = self.replicas = self.links = 0

    def distances(self, pivot: int, idx: np.ndarray) -> np.ndarray:
        """From the pivot to the rows idx; rows within the distance are linked to it."""
        own = self.flat[self.offs[pivot] : self.offs[pivot + 1]]
        self.mark[own] = 1
        n = self.n[idx]
        at = np.repeat(self.offs[idx] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        inter = np.add.reduceat(self.mark[self.flat[at]], np.cumsum(n) - n) if len(at) else np.zeros(len(idx), np.int64)
        self.mark[own] = 0
        either = n + len(own) - inter
        for j in idx[100 * inter >= self.percent * either]:
            self.union.join(pivot, int(j))
        return 1 - inter / either

    def solve(self, idx: np.ndarray | None = None) -> np.ndarray:
        """The root of each row's component. pivots, cells, replicas, links count what the pivots did."""
        idx = np.arange(len(self.n)) if idx is None else idx
        if len(idx) < 2:
            return self.union.roots()
        pivots, d = [int(idx[0])], [self._pivot(int(idx[0]), idx)]
        while len(pivots) < PIVOTS:
            far = np.min(d, axis=0)
            if far.max() <= self.eps:
                break
            pivots.append(int(idx[far.argmax()]))
            d.append(self._pivot(pivots[-1], idx))
        d = np.array(d)
        cells = d <= d.min(axis=0) + 2 * self.eps
        sizes = cells.sum(axis=1)
        if sizes.sum() <= 1.5 * len(idx) and sizes.max() <= 0.7 * len(idx):
            self.cells += len(cells)
            self.replicas += int(sizes.sum()) - len(idx)
            for cell in cells:
                if cell.sum() > 1:
                    self.solve(idx[cell])
            return self.union.roots()
        done = set(pivots)
        while True:
            root = self.union.roots()[idx]
            names, counts = np.unique(root, return_counts=True)
            wait = np.flatnonzero(root != names[counts.argmax()])
            wait = next((int(k) for k in wait if int(idx[k]) not in done), None)
            if wait is None:
                return self.union.roots()
            done.add(int(idx[wait]))
            near = (np.abs(d - d[:, wait : wait + 1]) <= self.eps).all(axis=0) & (root != root[wait])
            if near.any():
                self._pivot(int(idx[wait]), idx[near])

    def _pivot(self, pivot: int, idx: np.ndarray) -> np.ndarray:
        d = self.distances(pivot, idx)
        self.pivots += 1
        self.links += int((d <= self.eps).sum()) - int((idx == pivot).any())
        return d


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles that a sample finds in many documents, ascending. They order work and decide no result."""

    def scan(batches):
        for batch in batches:
            for _, _, buf, offs in K.slices(batch.column(0)):
                _, h = K.shingle_sets(K.Words(buf, offs, K.WHITE, True), k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    sample = docs.where(f"pmod(xxhash64(doc_id), {SAMPLE}) = 0").select("text").mapInArrow(scan, "h long")
    often = sample.groupBy("h").agg(F.count("*").alias("n")).where(f"n >= {SEEN}").orderBy(F.desc("n"), "h").limit(MOST_COMMON)
    return np.sort(often.select("h").toArrow().column(0).to_numpy().view(np.uint64))


def _scan(docs: DataFrame, k: int, percent: int, buckets: int, common) -> DataFrame:
    """kind 0: signatures as packed (hash, doc); 1: a doc with its set's size and digest; 2: pairs found on the way."""

    def scan(batches):
        signatures = Signatures(percent, common.value)
        for batch in batches:
            for a, b, buf, offs in K.slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                known = np.asarray(ids.is_valid())
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                doc, h = K.shingle_sets(K.Words(buf, offs, K.WHITE, True), k)
                n = np.bincount(doc, minlength=b - a)
                first = np.cumsum(n) - n
                digest = np.zeros(b - a, np.uint64)
                if len(h):
                    has = n > 0
                    digest[has] = np.add.reduceat(K.mix(h ^ K.U(0x5DEECE66D)), first[has])
                    digest = K.mix(digest + n.astype(np.uint64))
                # equal sets are one point: only the first of a slice that has an id goes on
                some = np.flatnonzero(known)
                _, lead = np.unique(digest[some], return_index=True)
                is_lead = np.zeros(b - a, bool)
                is_lead[some[lead]] = True
                goes = is_lead[doc]
                at, sig = signatures.sign(doc[goes], h[goes], np.where(is_lead, n, 0))
                at = ids[at]
                o = np.lexsort((at, sig))
                sig, at = sig[o], at[o]
                out = []
                if len(sig):
                    new = np.ones(len(sig), bool)
                    new[1:] = sig[1:] != sig[:-1]
                    least = at[new][np.cumsum(new) - 1]
                    pair = np.unique(np.stack([at[~new], least[~new]], 1), axis=0)
                    if len(pair):
                        out.append((0, 2, K.pack(pair[:, 0]), K.pack(pair[:, 1]), None))
                    sig, at = sig[new], at[new]
                    for c, s, i in K.by_bucket(((sig >> K.U(32)) * K.U(buckets) >> K.U(32)).astype(np.int64), sig, at):
                        out.append((c, 0, K.pack(s), K.pack(i), None))
                out.append((int(ids[0]) % buckets, 1, K.pack(ids[some]), K.pack(n[some]), K.pack(digest[some])))
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "kind", "a", "b", "c"), r, strict=True)) for r in out], schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]))

    def gather(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids = [], []

        def rows(kind, a, b, c=None):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64) if c is None else c)], names=["kind", "a", "b", "c"])

        for batch in batches:
            for kind, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True):
                if kind == 0:
                    sigs.append(K.unpack(a, np.uint64))
                    ids.append(K.unpack(b, np.int64))
                else:
                    yield rows(kind, K.unpack(a, np.int64), K.unpack(b, np.int64), K.unpack(c, np.int64) if c else None)
        if sigs:
            s, i = np.concatenate(sigs), np.concatenate(ids)
            o = np.lexsort((i, s))
            s, i = s[o], i[o]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            least = i[new][np.cumsum(new) - 1]
            pair = np.unique(np.stack([i[~new], least[~new]], 1), axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            yield rows(2, pair[:, 0], pair[:, 1])

    return docs.select("doc_id", "text").mapInArrow(scan, "bucket int, kind int, a binary, b binary, c binary").groupBy("bucket").applyInArrow(gather, "kind int, a long, b long, c long")


def _solve(rows: DataFrame, name: str, percent: int, sets) -> DataFrame:
    """Links (a, b) inside each cell, a cell in one task; sets: of a cell's table, ids, flat sets and offsets."""

    def solve(cell: list[pa.RecordBatch]):
        ids, flat, offs = sets(pa.Table.from_batches(cell).combine_chunks())
        some = np.flatnonzero(np.diff(offs))
        if len(some) < 2:
            return
        n = np.diff(offs)[some]
        r = Region(flat, np.concatenate([[0], np.cumsum(n)]), percent)
        root = r.solve()
        pair = np.stack([ids[some], ids[some][root]], 1)
        pair = pair[pair[:, 0] != pair[:, 1]]
        if len(pair):
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(batches):
        # rows come sorted by cell: one cell is held at a time
        held, now = [], None
        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if cell[a] != now and held:
                    yield from solve(held)
                    held = []
                now = cell[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(held)

    return rows.repartition(name).sortWithinPartitions(name, "doc_id").mapInArrow(run, "a long, b long")


def _join_regions(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, region) -> (a, b) links; the texts meet, and their sets are made where they are joined."""

    def sets(t: pa.Table):
        flat, sizes = [], []
        for _, _, buf, offs in K.slices(t.column("text").combine_chunks()):
            doc, h = K.shingle_sets(K.Words(buf, offs, K.WHITE, True), k)
            flat.append(h)
            sizes.append(np.bincount(doc, minlength=len(offs) - 1))
        return t.column("doc_id").to_numpy(), np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    return _solve(members.join(docs.select("doc_id", "text"), "doc_id").select("region", "doc_id", "text"), "region", percent, sets)


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = t.column("s").combine_chunks()
    offs = s.offsets.to_numpy().astype(np.int64)
    return t.column("doc_id").to_numpy(), s.values.to_numpy()[offs[0] : offs[-1]].view(np.uint64), offs - offs[0]


def _shingle_rows(members: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(region, doc_id, s, row): stored sets of the members; rows that repeat a doc_id have a row each."""

    def sets(batches):
        for batch in batches:
            for a, b, buf, offs in K.slices(batch.column("text")):
                doc, h = K.shingle_sets(K.Words(buf, offs, K.WHITE, True), k)
                n = np.bincount(doc, minlength=b - a)
                yield pa.RecordBatch.from_arrays([batch.column("region").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))], names=["region", "doc_id", "s"])

    rows = members.join(docs.select("doc_id", "text"), "doc_id").select("region", "doc_id", "text").mapInArrow(sets, "region long, doc_id long, s array<long>")
    return runtime.cut(rows.where("size(s) > 0").withColumn("row", F.monotonically_increasing_id()), "sets")


def _refine(sets: DataFrame, percent: int) -> DataFrame:
    """sets (region, doc_id, s), their regions split again: a link needs a common shingle among the first of both, rarest of the region first.

    Of a set's n shingles the first n - ceil(n * percent / 100) + 1 count, less those that no other member has. So
    members that share only what nearly all share part here. The counts are exact and of the region alone; they are
    combined before the shuffle, and rows of very common shingles are dealt over tasks. Unlinked members go.
    """
    on = ["region", "x"]
    items = sets.select("region", "doc_id", F.size("s").alias("size"), F.explode("s").alias("x"))
    counts = runtime.cut(items.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), "counts")
    known = runtime.meet(items, counts.withColumnRenamed("n", "times"), on, counts, "doc_id")
    # what no other set has comes first in the order, and isn't looked at
    rows = known.groupBy("region", "doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("times", "x"))).alias("l"))
    first = F.expr(f"slice(l, 1, greatest(0, size(l) + 1 - CAST(ceil(size * {percent} / 100) AS INT)))")
    prefix = runtime.cut(rows.select("region", "doc_id", F.explode(first).alias("e")).select("region", "doc_id", "e.x"), "prefix")
    heads = prefix.groupBy(*on).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("least < last")
    heads = runtime.cut(heads.drop("last"), "heads")
    stars = runtime.meet(prefix, heads.drop("n"), on, heads.drop("least"), "doc_id")
    parts = runtime.connected_components(stars.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    out = sets.drop("region").join(parts, F.col("doc_id") == F.col("node")).select(F.col("component").alias("region"), "doc_id", "s")
    out = runtime.cut(out, "refined")
    runtime.drop(counts, prefix, heads, parts)
    return out


def _dealt(sets: DataFrame) -> DataFrame:
    """(cell, doc_id, s, part): the members of each cell in parts of LARGE_PART rows or REGION_SHINGLES shingles, about; part counts from 0 in parts."""
    sizes = runtime.cut(sets.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("shingles")), "sizes")
    parts = F.greatest(F.ceil(F.col("n") / LARGE_PART), F.ceil(F.col("shingles") / REGION_SHINGLES)).alias("parts")
    rows = runtime.meet(sets, sizes.select("cell", parts), ["cell"], sizes.select("cell", "n"), "doc_id")
    return runtime.cut(rows.withColumn("part", F.expr("pmod(xxhash64(doc_id), parts)")), "dealt")


def _beside(members: DataFrame, pivots: DataFrame, percent: int, schema: str, answer) -> DataFrame:
    """Each part of each cell with all pivots (cell, p, ps) of the cell, in one task: answer(cell, ids, pivot ids, distances)."""
    copies = members.select("cell", "parts").distinct().join(pivots, "cell").select("cell", F.col("p").alias("doc_id"), F.col("ps").alias("s"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(True).alias("pivot"))
    rows = members.select("cell", "doc_id", "s", "part", F.lit(False).alias("pivot")).unionByName(copies)

    def run(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([("pivot", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        ids, flat, offs = _flat(t)
        n = int(t.num_rows - sum(t.column("pivot").to_pylist()))
        r = Region(flat, offs, percent)
        if n and len(ids) > n:
            yield answer(key[0].as_py(), ids[:n], ids[n:], np.array([r.distances(j, np.arange(n)) for j in range(n, len(ids))]))

    return rows.groupBy("cell", "part").applyInArrow(run, schema)


def _links(eps: float):
    def answer(cell, ids, pivots, d):
        p, m = np.nonzero(d <= eps)
        keep = pivots[p] != ids[m]
        return pa.RecordBatch.from_arrays([pa.array(ids[m][keep]), pa.array(pivots[p][keep])], names=["a", "b"])

    return answer


def _join_large(sets: DataFrame, percent: int, region_rows: int, region_shingles: int) -> DataFrame:
    """Links (a, b) of regions too large for a task; sets: region, doc_id (one row each), s."""
    eps = 1 - percent / 100 + 1e-9
    sets, links = _refine(sets, percent).select(F.col("region").alias("cell"), "doc_id", "s"), []
    fits = F.expr(f"n <= {region_rows} AND shingles <= {region_shingles}")
    while True:
        size = runtime.cut(sets.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("shingles")).where("n > 1"), "sizes")
        links.append(runtime.cut(_solve(sets.join(size.where(fits), "cell", "left_semi").select("cell", "doc_id", "s"), "cell", percent, _flat), "links"))
        if size.where(~fits).isEmpty():
            out = links[0]
            for x in links[1:]:
                out = out.union(x)
            return out
        sets = sets.join(size.where(~fits), "cell", "left_semi")
        members = _dealt(sets)
        # the pivots of a cell: its members of least hash, a sample that doesn't depend on the order
        least = _least(members.withColumn("size", F.size("s")), PIVOTS)
        pivots = runtime.cut(members.join(least, ["cell", "doc_id"], "left_semi").select("cell", F.col("doc_id").alias("p"), F.col("s").alias("ps")), "pivots")

        def cells(cell, ids, own, d, eps=eps):
            # -1: a link; else the place of a pivot whose cell the member goes to
            p, m = np.nonzero(d <= eps)
            q, k = np.nonzero(d <= d.min(axis=0) + 2 * eps)
            keep = own[p] != ids[m]
            return pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum() + len(k), cell)), pa.array(np.concatenate([ids[m][keep], ids[k]])), pa.array(np.concatenate([own[p][keep], own[q]])), pa.array(np.concatenate([np.ones(keep.sum(), bool), np.zeros(len(k), bool)]))], names=["cell", "a", "b", "link"])

        found = runtime.cut(_beside(members, pivots, percent, "cell long, a long, b long, link boolean", cells), "voronoi")
        links.append(found.where("link").select("a", "b"))
        child = found.where("NOT link").groupBy("cell", "b").agg(F.count("*").alias("n"))
        before = members.groupBy("cell").agg(F.count("*").alias("all"))
        shrunk = child.groupBy("cell").agg(F.max("n").alias("largest"), F.sum("n").alias("total")).join(before, "cell").select("cell", F.expr("total <= 1.5 * `all` AND largest <= 0.7 * `all`").alias("shrunk"))
        shrunk = runtime.cut(shrunk, "shrunk")
        dense = members.join(shrunk.where("NOT shrunk"), "cell", "left_semi")
        if not dense.isEmpty():
            links.append(_join_dense(dense, percent))
        moved = found.where("NOT link").join(shrunk.where("shrunk"), "cell", "left_semi").select("cell", F.col("a").alias("doc_id"), F.xxhash64("cell", "b").alias("next"))
        sets = runtime.cut(moved.join(members.select("cell", "doc_id", "s"), ["cell", "doc_id"]).select(F.col("next").alias("cell"), "doc_id", "s"), "sets")


def _least(members: DataFrame, n: int, turn: int = 0) -> DataFrame:
    """(cell, doc_id): about n members of each cell of least hash, one at least and REGION_SHINGLES shingles at most, about; no cell is sorted as a whole."""
    x = F.pmod(F.xxhash64(F.lit(turn), "doc_id"), F.lit(1 << 40))
    low = members.groupBy("cell").agg(F.count("*").alias("waiting"), F.min(x).alias("low"), F.sum("size").alias("shingles"))
    low = low.withColumn("most", F.expr(f"least({n}, {REGION_SHINGLES} * waiting / shingles)"))
    return members.join(low, "cell").withColumn("x", x).where(F.expr(f"x = low OR waiting <= most OR x < most * {1 << 40} / waiting")).select("cell", "doc_id").distinct()


def _join_dense(members: DataFrame, percent: int, pivots: int = 64) -> DataFrame:
    """Cells that pivots don't split: pivots against all members, until only the largest component has members that weren't one.

    Each round takes four times as many pivots as the one before, so their number grows with the rounds' power.
    """
    members = runtime.cut(members.select("cell", "doc_id", "s", "part", "parts"), "dense")
    used, links, turn = None, None, 1
    while True:
        state = members.select("cell", "doc_id", F.size("s").alias("size"))
        if links is not None:
            comp = runtime.connected_components(links)
            state = state.join(comp, F.col("doc_id") == F.col("node"), "left").select("cell", "doc_id", "size", F.coalesce("component", "doc_id").alias("component"))
            counts = state.groupBy("cell", "component").count()
            big = counts.groupBy("cell").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("big"))
            state = state.join(big, "cell").where("component <> big").join(used, ["cell", "doc_id"], "left_anti")
        chosen = runtime.cut(_least(state, pivots, turn), "pivots")
        if chosen.isEmpty():
            return links
        used = chosen if used is None else used.union(chosen)
        p = members.join(chosen, ["cell", "doc_id"], "left_semi").select("cell", F.col("doc_id").alias("p"), F.col("s").alias("ps"))
        found = runtime.cut(_beside(members, p, percent, "a long, b long", _links(1 - percent / 100 + 1e-9)), "links")
        links = found if links is None else links.union(found)
        turn, pivots = turn + 1, pivots * 4


def _sized(rows: DataFrame, size: DataFrame) -> DataFrame:
    """rows with rows and shingles of their region; a region that holds a third of all is dealt over tasks."""
    return runtime.meet(rows, size, ["region"], size.select("region", F.col("rows").alias("n")), "doc_id")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, region_rows: int = REGION_ROWS, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    runtime.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    buckets = max(32, docs.count() // BUCKET_DOCS)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))
    found = runtime.cut(_scan(docs, k, percent, buckets, common), "scan")
    common.destroy()  # what it served is written
    each = found.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("digest"))
    point = runtime.cut(each.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies")), "points")
    again = point.where("copies > 1")
    equal = runtime.meet(each.where("n > 0").select("doc_id", "digest"), again.select("digest", "rep"), ["digest"], again.select("digest", F.col("copies").alias("n")), "doc_id")
    equal = runtime.cut(equal.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "equal")
    regions = runtime.connected_components(found.where("kind = 2").select("a", "b").union(equal))
    members = point.join(regions, F.col("rep") == F.col("node")).select(F.col("component").alias("region"), F.col("rep").alias("doc_id"), "n")
    size = runtime.cut(members.groupBy("region").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).where("rows > 1"), "sizes")
    members = runtime.cut(_sized(members, size).select("region", "doc_id", "rows", "shingles").distinct(), "members")
    fits = F.expr(f"rows <= {region_rows} AND shingles <= {region_shingles}")
    links = equal.union(runtime.cut(_join_regions(members.where(fits).select("region", "doc_id"), docs, k, percent), "links"))
    large = members.where(~fits).select("region", "doc_id")
    if not large.isEmpty():
        sets = _shingle_rows(large, docs, k)
        found = _join_large(sets.select("region", F.col("row").alias("doc_id"), "s"), percent, region_rows, region_shingles)
        name = sets.select("row", F.col("doc_id").alias("d"))
        found = found.join(name.withColumnRenamed("d", "x"), F.col("a") == F.col("row")).drop("row").join(name.withColumnRenamed("d", "y"), F.col("b") == F.col("row"))
        links = links.union(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    comp = runtime.connected_components(links)
    runtime.drop(point, equal, regions, size, members)
    nodes = each.select("doc_id", F.col("n").alias("n_shingles")).join(comp, F.col("doc_id") == F.col("node"), "left")
    nodes = nodes.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = docs.where("doc_id IS NULL")
    if not nameless.isEmpty():
        nodes = nodes.union(nameless.mapInArrow(_count_only(k), "doc_id long, n_shingles long, component_id long"))
    return nodes


def _count_only(k: int):
    def count(batches):
        for batch in batches:
            for a, b, buf, offs in K.slices(batch.column(1)):
                doc, _ = K.shingle_sets(K.Words(buf, offs, K.WHITE, True), k)
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(np.bincount(doc, minlength=b - a)), none], names=["doc_id", "n_shingles", "component_id"])

    return count
