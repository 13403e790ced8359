"""Line deduplication by pairwise alignment.

A document is the sequence of its \\n-separated lines' 64-bit hashes. With every=True, which the query and the pipeline
use, overlapping documents are found through shared rare runs: the shortest runs of neighbouring lines that have
MIN_WORDS words together (two characters of a script without spaces count as one) and are in RARE documents at most. A document
and every earlier one that share such a run are aligned by patience diff (lines unique on both sides, longest increasing
sequence, grown to their neighbours, again between them), and every aligned block of MIN_WORDS words or more is deleted
from the later one. A run in more than RARE documents finds no partners, which would be as many as its documents' pairs: it is an
aligned block of its own, deleted from all documents but the earliest. Equal sequences of lines are deleted as a whole from
all but the first document. So a document meets RARE partners for each of its runs at most, groups of thousands are
found like groups of two, and nothing is left out. Alignments are judged on the input, not on what other pairs leave.

Documents are reduced to the lines that others have too, with markers for the rest; equal reductions (shapes) align alike, so one
stands for all. Rows of very common lines and of partners of many documents are dealt over tasks.

The default of dedup_lines() is simpler: lines of MIN_WORDS words are anchors, each document is aligned with the earliest
holder of each of its anchors only, and a block goes if it holds an anchor.

Defined results: null text stays null and has no lines; empty lines belong to no sequence and always stay, also between
lines that go; an empty table gives no rows; other columns of docs may have any names and stay; rows without a doc_id stay as they are; rows that repeat a doc_id aren't compared with each other; ties can't occur, as equal
texts of one doc_id change alike. A document that loses all its words keeps its row in dedup_lines() (empty text).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import runtime

MIN_WORDS = 5
#: A run of lines in more documents than this finds no partners: it is a block of its own.
RARE = 20


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], ascending on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        pairs = sorted((i, once_b[x]) for x, i in once_a.items() if x in once_b)
        chain = _rising(pairs)
        if not chain:
            continue
        i, j = a0, b0
        for p, q in [*chain, (a1, b1)]:
            todo.append((i, p, j, q))
            if p < a1:
                out.append((p, q))
            i, j = p + 1, q + 1
    return sorted(out)


def _once(x: list[int], lo: int, hi: int) -> dict[int, int]:
    at: dict[int, int] = {}
    for i in range(lo, hi):
        at[x[i]] = -1 if x[i] in at else i
    return {k: i for k, i in at.items() if i >= 0}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence whose second places rise."""
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        t = bisect_left(tails, j)
        back[k] = last[t - 1] if t else -1
        if t == len(tails):
            tails.append(j)
            last.append(k)
        else:
            tails[t], last[t] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_blocks(a: list[int], b: list[int], anchor: list[bool]) -> list[int]:
    """Places in b of aligned blocks that hold an anchor line."""
    gone, block = [], []
    for i, j in [*patience(a, b), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if any(anchor[q] for _, q in block):
                gone += [q for _, q in block]
            block = []
        block.append((i, j))
    return gone


def _runs(h: list, weight: list[int]) -> list[tuple[int, int, int]]:
    """(first, last, key) of the shortest runs from a line on and up to a line that weigh MIN_WORDS, without markers (None).

    A block of MIN_WORDS that holds a line holds one of these runs around that line.
    """
    mask = (1 << 64) - 1
    power, sums = [1], [0]
    for x in h:
        power.append(power[-1] * 0x9E3779B97F4A7C15 & mask)
        sums.append((sums[-1] * 0x9E3779B97F4A7C15 + (x or 0)) & mask)
    found, first, total = set(), 0, 0
    up = []
    for j, x in enumerate(h):
        if x is None:
            first, total, up = j + 1, 0, []
            continue
        total += weight[j]
        up.append(j)
        # up: the starts without a run yet; first: the last start from which the lines up to j weigh enough
        if total >= MIN_WORDS:
            while total - weight[first] >= MIN_WORDS:
                total -= weight[first]
                first += 1
            found.add((first, j))
            done = bisect_right(up, first)
            found.update((i, j) for i in up[:done])
            del up[:done]
    out = []
    for i, j in sorted(found):
        n = j + 1 - i
        key = ((sums[j + 1] - sums[i] * power[n]) * 0xD6E8FEB86659FD93 + n) & mask
        out.append((i, j, key - (1 << 64) if key >> 63 else key))
    return out


def heavy_blocks(a: list, b: list, weight: list[int]) -> list[int]:
    """Places in b of aligned blocks that weigh MIN_WORDS. Markers (None) stand for lines that never align."""
    gone, block = [], []
    for i, j in [*patience(a, ["" if x is None else x for x in b]), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(weight[q] for _, q in block) >= MIN_WORDS:
                gone += [q for _, q in block]
            block = []
        block.append((i, j))
    return gone


def _lines(docs: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            for a, b, buf, offs in K.slices(batch.column("text")):
                lines = K.Words(buf, offs, K.LINES, False)
                words = K.Words(buf, offs, K.WHITE, False, hashes=False)
                n = np.searchsorted(words.starts, lines.ends) - np.searchsorted(words.starts, lines.starts)
                # a line's number counts the line breaks before it in its text
                breaks = np.concatenate([[0], np.cumsum(buf == 10)])
                number = breaks[lines.starts] - breaks[offs[lines.doc]]
                # scripts without spaces (Han, kana, Thai, Lao): two characters weigh a word
                after = np.append(buf[1:], 0)
                chars = np.concatenate([[0], np.cumsum((buf >= 0xE3) & (buf <= 0xE9) | (buf == 0xE0) & (after >= 0xB8) & (after <= 0xBB))])
                weight = np.maximum(n, (chars[lines.ends] - chars[lines.starts]) // 2)
                per = pa.array(lines.first.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a), *(pa.ListArray.from_arrays(per, x) for x in (pa.array(lines.h.view(np.int64)), pa.array(n >= MIN_WORDS), pa.array(weight.astype(np.int32)), pa.array(number.astype(np.int32))))], names=["doc_id", "th", "h", "anchor", "weight", "number"])

    return docs.mapInArrow(scan, "doc_id long, th long, h array<long>, anchor array<boolean>, weight array<int>, number array<int>")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): for each document with deletions (th: xxhash64 of its text), the numbers of the lines to delete."""
    runtime.ship(docs.sparkSession)
    lines = runtime.cut(_lines(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))), "lines")
    shared = lines.select("doc_id", "th", F.explode(F.array_distinct(F.expr("filter(h, (x, i) -> anchor[i])"))).alias("x"))
    owner = shared.groupBy("x").agg(F.min(F.struct("doc_id", "th")).alias("o"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("o.doc_id < last")
    owner = runtime.cut(owner.select("x", F.col("o.doc_id").alias("o_id"), F.col("o.th").alias("o_th"), "n"), "owner")
    pairs = runtime.meet(shared, owner.drop("n"), ["x"], owner, "doc_id").where("doc_id > o_id").select("doc_id", "th", "o_id", "o_th").distinct()
    pairs = runtime.cut(pairs, "pairs")
    partners = runtime.cut(pairs.groupBy("o_id", "o_th").agg(F.count("*").alias("n")), "partners")
    # equal texts of one doc_id have equal lines: one row of them will do
    one = lines.dropDuplicates(["doc_id", "th"])
    later = pairs.join(one.select("doc_id", "th", F.col("h").alias("b"), "anchor", "number"), ["doc_id", "th"])
    both = runtime.meet(later, one.select(F.col("doc_id").alias("o_id"), F.col("th").alias("o_th"), F.col("h").alias("a")), ["o_id", "o_th"], partners, "doc_id")

    def align(batches):
        for batch in batches:
            ids, th, gone = [], [], []
            for d, t, a, b, anchor, number in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "th", "a", "b", "anchor", "number")), strict=True):
                found = common_blocks(a, b, anchor)
                if found:
                    ids.append(d)
                    th.append(t)
                    gone.append([number[j] for j in found])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "th": pa.array(th, pa.int64()), "gone": pa.array(gone, pa.list_(pa.int32()))})

    found = both.select("doc_id", "th", "a", "b", "anchor", "number").mapInArrow(align, "doc_id long, th long, gone array<int>")
    # a document has no more partners than lines, so what meets here is bounded by its own length
    return found.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _shapes(lines: DataFrame) -> DataFrame:
    """(doc_id, th, s, h, weight, number, keys): the documents of which a line is also in another document, each run of other lines as one marker.

    Documents with one shape s align alike with any third document.
    """
    each = lines.select("doc_id", "th", F.posexplode("h").alias("at", "x"))
    held = each.groupBy("x").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")
    held = runtime.cut(held.select("x", "n"), "held")
    places = runtime.meet(each, held.select("x"), ["x"], held, "doc_id").groupBy("doc_id", "th").agg(F.collect_list("at").alias("places"))

    def shape(batches):
        for batch in batches:
            out = {x: [] for x in ("doc_id", "th", "s", "h", "weight", "number", "keys")}
            for d, t, h, weight, number, places in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "th", "h", "weight", "number", "places")), strict=True):
                row, last = ([], [], []), -1
                for j in [*sorted(places), len(h)]:
                    if j > last + 1:
                        for x, v in zip(row, (None, 0, -1), strict=True):
                            x.append(v)
                    if j < len(h):
                        for x, v in zip(row, (h[j], weight[j], number[j]), strict=True):
                            x.append(v)
                    last = j
                s = hashlib.blake2b(repr(row[0]).encode(), digest_size=8).digest()
                for x, v in zip(out, (d, t, int.from_bytes(s, "little", signed=True), *row, sorted({k for _, _, k in _runs(row[0], row[1])})), strict=True):
                    out[x].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if x in ("doc_id", "th", "s") else pa.list_(pa.int64() if x in ("h", "keys") else pa.int32())) for x, v in out.items()], names=list(out))

    one = lines.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "h", "weight", "number")
    return runtime.cut(one.join(places, ["doc_id", "th"]).mapInArrow(shape, "doc_id long, th long, s long, h array<long>, weight array<int>, number array<int>, keys array<long>"), "shapes")


def _align(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """(s, o_s, o_id) -> (s, at, o_id): the places of a shape that its partners align, with the earliest of them."""
    pairs = runtime.cut(pairs.distinct(), "pairs")
    own = runtime.cut(pairs.groupBy("s").agg(F.count("*").alias("n")), "own")
    partners = runtime.cut(pairs.groupBy("o_s").agg(F.count("*").alias("n")), "partners")
    later = runtime.meet(pairs, first.select("s", F.col("h").alias("b"), "weight"), ["s"], own, "o_s")
    both = runtime.meet(later, first.select(F.col("s").alias("o_s"), F.col("h").alias("a")), ["o_s"], partners, "s")

    def align(batches):
        for batch in batches:
            rows = [(s, o, heavy_blocks(a, b, weight)) for s, o, a, b, weight in zip(*(batch.column(x).to_pylist() for x in ("s", "o_id", "a", "b", "weight")), strict=True)]
            rows = [x for x in rows if x[2]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], v) for k, v in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["s", "o_id", "gone"])

    found = both.select("s", "o_id", "a", "b", "weight").mapInArrow(align, "s long, o_id long, gone array<int>")
    return runtime.cut(found.select("s", "o_id", F.explode("gone").alias("at")).groupBy("s", "at").agg(F.min("o_id").alias("o_id")), "aligned")


def _common_runs(keys: DataFrame, first: DataFrame) -> DataFrame:
    """(s, key, o_id) of common runs -> (s, at, o_id): their lines' places in each shape, with the earliest holder."""

    def place(batches):
        for batch in batches:
            out = {"s": [], "at": [], "o_id": []}
            for s, h, weight, common in zip(*(batch.column(x).to_pylist() for x in ("s", "h", "weight", "common")), strict=True):
                holder, least = {x["key"]: x["o_id"] for x in common}, {}
                for i, j, key in _runs(h, weight):
                    if key in holder:
                        for x in range(i, j + 1):
                            least[x] = min(least.get(x, holder[key]), holder[key])
                out["s"] += [s] * len(least)
                out["at"] += list(least)
                out["o_id"] += list(least.values())
            yield pa.RecordBatch.from_arrays([pa.array(out["s"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["o_id"], pa.int64())], names=["s", "at", "o_id"])

    # a shape has no more runs than twice its lines
    common = keys.groupBy("s").agg(F.collect_list(F.struct("key", "o_id")).alias("common"))
    return runtime.cut(first.select("s", "h", "weight").join(common, "s").mapInArrow(place, "s long, at int, o_id long"), "common")


def every_repeated_line(docs: DataFrame) -> DataFrame:
    """As repeated_lines(), but with the blocks that any earlier document aligns.

    Shapes are aligned instead of documents, each with the earliest document of every other shape that shares a rare run:
    first with a run's earliest holder, then, for the runs that this left, with all others, of which there are RARE at
    most. A run in more than RARE documents is a block of its own, aligned with its earliest holder whatever stands around it.
    """
    runtime.ship(docs.sparkSession)
    shapes = _shapes(runtime.cut(_lines(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))), "lines"))
    sizes = runtime.cut(shapes.groupBy("s").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "sizes")

    def own(batches):
        for batch in batches:
            owns, until = [], []
            for h, weight, i, last in zip(*(batch.column(x).to_pylist() for x in ("h", "weight", "id", "last")), strict=True):
                # without a marker, equal shapes are equal texts, which need no weight
                owns.append(heavy_blocks(h, h, weight) if None in h else list(range(len(h))))
                # where the first document aligns all that could be aligned, later ones of its shape need no other partner
                until.append(i if {x for p, q, _ in _runs(h, weight) for x in range(p, q + 1)} <= set(owns[-1]) else last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(owns, pa.list_(pa.int32())), pa.array(until, pa.int64())], names=[*batch.schema.names[:-1], "own", "until"])

    reps = sizes.select(F.col("r.doc_id").alias("doc_id"), F.col("r.th").alias("th"), F.col("n").alias("docs"), "last")
    first = shapes.join(reps, ["doc_id", "th"]).select("s", F.col("doc_id").alias("id"), "h", "weight", "keys", "docs", "last")
    first = runtime.cut(first.mapInArrow(own, "s long, id long, h array<long>, weight array<int>, keys array<long>, docs long, own array<int>, until long"), "first")
    keyed = runtime.cut(first.select("s", "id", "until", "docs", F.explode("keys").alias("key")), "keyed")
    every = keyed.groupBy("key").agg(F.min(F.struct("id", "s")).alias("o"), F.count("*").alias("n"), F.sum("docs").alias("docs")).where("docs > 1")
    every = runtime.cut(every.select("key", F.col("o.id").alias("o_id"), F.col("o.s").alias("o_s"), "n", "docs"), "owner")
    owner = every.where(f"docs <= {RARE} AND n > 1").drop("docs")
    often = every.where(f"docs > {RARE}").select("key", "o_id", "n")
    common = _common_runs(runtime.meet(keyed.select("s", "key"), often.drop("n"), ["key"], often.select("key", "n"), "s"), first)
    star = runtime.meet(keyed, owner.drop("n"), ["key"], owner, "s").where("o_id < until AND o_s <> s")
    near = _align(star.select("s", "o_s", "o_id"), first)
    done = first.select("s", "id").join(near, "s").where("o_id < id").groupBy("s").agg(F.collect_list("at").alias("gone"))

    def rest(batches):
        for batch in batches:
            shape, until, keys = [], [], []
            for s, u, h, weight, gone in zip(*(batch.column(x).to_pylist() for x in ("s", "until", "h", "weight", "gone")), strict=True):
                gone = set(gone or ())
                for k in {k for i, j, k in _runs(h, weight) if any(x not in gone for x in range(i, j + 1))}:
                    shape.append(s)
                    until.append(u)
                    keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shape, until, keys)], names=["s", "until", "key"])

    left = first.where("size(keys) > 0").join(done, "s", "left").select("s", "until", "h", "weight", "gone").mapInArrow(rest, "s long, until long, key long")
    left = runtime.cut(runtime.meet(left, owner, ["key"], owner.select("key", "n"), "s").where("o_id < until").select("key", "s", "until"), "left")
    sought = runtime.cut(owner.join(left.select("key").distinct(), "key", "left_semi").select("key", "n"), "sought")
    holders = keyed.select("key", F.col("s").alias("o_s"), F.col("id").alias("o_id"))
    far = _align(runtime.meet(holders, left, ["key"], sought, "o_s").where("o_id < until AND o_s <> s").select("s", "o_s", "o_id"), first)
    found = near.unionByName(far).unionByName(common).groupBy("s", "at").agg(F.min("o_id").alias("o_id")).groupBy("s").agg(F.collect_list(F.struct("at", "o_id")).alias("found"))
    found = first.select("s", "id", "own").join(found, "s", "left")

    def number(batches):
        for batch in batches:
            gone = []
            for d, numbers, i, owns, found in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "number", "id", "own", "found")), strict=True):
                places = {x["at"] for x in found or () if x["o_id"] < d}
                gone.append([numbers[j] for j in (places.union(owns) if i < d else places)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "th", "gone"])

    rows = runtime.meet(shapes.select("doc_id", "th", "s", "number"), found, ["s"], sizes.select("s", "n"), "doc_id")
    return rows.select("doc_id", "th", "number", "id", "own", "found").mapInArrow(number, "doc_id long, th long, gone array<int>").where("size(gone) > 0")


def dedup_lines(docs: DataFrame, count: bool = False, drop_emptied: bool = False, every: bool = False) -> DataFrame:
    """docs with the deletions made, all columns kept; count adds n_lines and n_removed (__lines, __removed).

    every: a block goes if any earlier document aligns it, not only the earliest holder of one of its lines.
    """
    name = "__gone" + "_" * max(map(len, docs.columns))  # no column of docs is called so
    gone = (every_repeated_line if every else repeated_lines)(docs).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias(name))
    rows = docs.join(gone.hint("shuffle_hash"), (docs["doc_id"].cast("long") == gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__th"]), "left").select(*(docs[c] for c in docs.columns), gone[name])
    schema = docs.schema
    if count:
        schema = schema.add("__lines", "long").add("__removed", "long")
    at = docs.columns.index("text")

    def apply(batches):
        for batch in batches:
            texts, n, removed, keep = batch.column(at).to_pylist(), [], [], []
            for k, gone in enumerate(batch.columns[-1].to_pylist()):
                out = texts[k]
                if gone or count:
                    own = (out or "").split("\n")
                    n.append(sum(1 for x in own if x))
                if gone:
                    drop = set(gone)
                    out = texts[k] = "\n".join(x for i, x in enumerate(own) if i not in drop)
                removed.append(len(gone or ()))
                keep.append(not (drop_emptied and gone and not out.strip(" \t\n\v\f\r")))
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, cols[at].type)
            names = batch.schema.names[:-1]
            if count:
                cols += [pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
                names += ["__lines", "__removed"]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return rows.mapInArrow(apply, schema)
