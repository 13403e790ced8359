"""Incremental substring deduplication with a log-structured fingerprint index.

A window is WINDOW consecutive words of one document. Its fingerprint is the least hash of its GRAM-word runs (winnowing),
so equal windows have equal fingerprints at equal places in them, and about one run in eight words is ever a fingerprint:
that is what makes a whole history storable. Neighbouring windows with one fingerprint are one entry: the fingerprint,
a hash of all words of these windows together, the place (doc_id, start) and the number of windows.

The index is a list of immutable runs on the shared storage, sorted by fingerprint and dealt to buckets by it. Nothing is
left out of a run but entries whose words an older run holds already. add() takes a batch of documents that come after
all earlier ones and merge-joins its sorted entries with every run, bucket by bucket: an entry that is there as a whole is
a claim that all its windows repeat; entries that share a fingerprint with others only are places to look at by window. The
batch's new entries become a run of their own. FAN runs of one tier are compacted into one of the next tier, so an
entry is rewritten once per tier.

repeats() settles claims and places from the texts: the windows at the places are hashed and compared, claims on one
diagonal are put together, and every claim is verified: the words of both places are read again from the texts and
have to have equal 160-bit blake2b digests. A claim that fails is dropped. One exchange of the texts serves all of this.

A fingerprint that very many documents hold, each among words of its own, would fill one bucket. Such fingerprints are
found on a sample of the batch (one document in SAMPLE; those in more than a thousandth of it, so they are few) and are
dealt by the hash of all words; their places are always looked at. The sample decides where rows go, never a result.

Inside a task, equal entries meet before the exchange, so a passage that fills a third of all documents sends one row per
task and not one per document.

Defined results: null or empty text has no words; a text shorter than a window loses nothing; rows without a doc_id come
before all others (the least long stands for null, so it can't be a doc_id); of rows that repeat a doc_id the same start isn't earlier, so equal rows don't remove each other's
words; an empty table gives no rows; other columns of docs aren't read. Output: one row per input row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import runtime

WINDOW = 20
GRAM = 6
#: Runs of a tier that are compacted into one.
FAN = 4
BATCHES = 2
BUCKET_DOCS = 1500
GATHER = 400_000
SAMPLE, OFTEN = 64, 32
_NONE = -(1 << 63)
_NEW, _CLAIM, _PLACE, _RUN = range(4)
_COLUMNS = ("h", "c", "doc", "pos", "n", "src", "at")
_TYPES = dict(zip(_COLUMNS, (np.uint64, np.uint64, np.int64, np.uint32, np.uint32, np.int64, np.uint32), strict=True))
_ROW = "kind int, bucket int, " + ", ".join(f"{c} binary" for c in _COLUMNS)
_PA_ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in _COLUMNS)])


def entries(w: K.Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(fingerprint, hash of all words, first window's first word, windows) of the entries of one slice, in order."""
    m = len(w.doc) - window + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if m <= 0:
        return none
    g = K.rolling(w.h, gram, 7)
    best, span, reach = np.arange(len(g)), 1, window - gram + 1
    while span < reach:
        # the first least of twice as many, or of as many as are missing
        step = min(span, reach - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(g[left] <= g[right], left, right)
        span += step
    whole = np.flatnonzero(w.doc[:m] == w.doc[window - 1 :])
    if not len(whole):
        return none
    anchor = best[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(whole))
    start, anchor = whole[first], anchor[first]
    power, inverse = K._power_tables(len(w.h) + 1)
    sums = np.zeros(len(w.h) + 1, np.uint64)
    np.cumsum(K.mix(w.h ^ K.U(0xC0FFEE)) * power[: len(w.h)], out=sums[1:])
    c = (sums[start + n + window - 1] - sums[start]) * inverse[start]
    return g[anchor], K.mix(c ^ K.mix((n << 32 | anchor - start).astype(np.uint64))), start, n


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NONE).to_numpy(zero_copy_only=False)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _PA_ROW, strict=True)], schema=_PA_ROW)


def _packed(kind: int, bucket: np.ndarray, **columns: np.ndarray) -> Iterator[tuple]:
    """Rows of packed columns, one for each bucket; buckets come in order."""
    names = list(columns)
    for b, *parts in K.by_bucket(bucket, *columns.values()):
        own = dict(zip(names, parts, strict=True))
        yield kind, b, *(K.pack(own[c].astype(_TYPES[c])) if c in own else None for c in _COLUMNS)


def _read(rows: list[dict], columns: tuple[str, ...]) -> list[np.ndarray]:
    return [np.concatenate([K.unpack(r[c], _TYPES[c]) for r in rows] or [np.zeros(0, _TYPES[c])]) for c in columns]


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> K.U(32)) * K.U(buckets) >> K.U(32)).astype(np.int64)


def _entry_rows(kind: int, buckets: int, hot: np.ndarray, h, c, doc, pos, n) -> Iterator[tuple]:
    """Packed entries, dealt by fingerprint, those of a hot one by all words; sorted as they come."""
    b = _bucket_of(h, buckets)
    often = np.isin(h, hot)
    b[often] = _bucket_of(K.mix(c[often]), buckets)
    o = np.argsort(b, kind="stable")
    return _packed(kind, b[o], h=h[o], c=c[o], doc=doc[o], pos=pos[o], n=n[o])


def hot_fingerprints(docs: DataFrame, window: int) -> np.ndarray:
    """Fingerprints in OFTEN or more sampled documents and in over a thousandth of them, ascending."""

    def scan(batches):
        for batch in batches:
            for _, _, buf, offs in K.slices(batch.column(0)):
                w = K.Words(buf, offs, K.WHITE, False)
                h, _, start, _ = entries(w, window)
                doc, h = K.distinct_by_doc(w.doc[start], h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    sample = docs.where(f"pmod(xxhash64(doc_id), {SAMPLE}) = 0")
    least = max(OFTEN, sample.count() // 1000)
    rows = sample.select("text").mapInArrow(scan, "h long").groupBy("h").agg(F.count("*").alias("n")).where(f"n >= {least}").select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def _claims(doc, pos, n, src, at, buckets: int) -> Iterator[tuple]:
    b = (K.mix(doc.view(np.uint64)) % K.U(buckets)).astype(np.int64)
    o = np.lexsort((pos, doc, b))
    yield from _packed(_CLAIM, b[o], doc=doc[o], pos=pos[o], n=n[o], src=src[o], at=at[o])


def _leads(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: (true at the first of equal ones, place of that first one for each)."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new, np.flatnonzero(new)[np.cumsum(new) - 1]


def _scan(docs: DataFrame, window: int, buckets: int, hot: np.ndarray) -> DataFrame:
    def flush(parts) -> pa.RecordBatch:
        h, c, doc, pos, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.lexsort((pos, doc, c, h))
        h, c, doc, pos, n = h[o], c[o], doc[o], pos[o], n[o]
        new, lead = _leads(h, c)
        later = (doc != doc[lead]) | (pos != pos[lead])
        rows = list(_claims(doc[later], pos[later], n[later], doc[lead][later], pos[lead][later], buckets))
        rows += _entry_rows(_NEW, buckets, hot, h[new], c[new], doc[new], pos[new], n[new])
        return _batch(rows)

    def scan(batches):
        parts, size = [], 0
        for batch in batches:
            for a, b, buf, offs in K.slices(batch.column(1)):
                w = K.Words(buf, offs, K.WHITE, False)
                h, c, start, n = entries(w, window)
                if len(h):
                    doc = w.doc[start]
                    parts.append((h, c, _ids(batch.column(0).slice(a, b - a))[doc], start - w.first[doc], n))
                    size += len(h)
                if size >= GATHER:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return docs.mapInArrow(scan, _ROW)


def _dealt(run: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """A run's rows, cut where the buckets of a larger index begin."""

    def deal(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own = {c: K.unpack(r[c], _TYPES[c]) for c in _COLUMNS[:5]}
                yield _batch(list(_entry_rows(_RUN, buckets, hot, **own)))

    return run.where(f"kind = {_RUN}").mapInArrow(deal, _ROW)


def _merge_join(rows: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Bucket by bucket, a batch's entries against the runs: claims, places and the batch's own run."""

    def merge(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, runs = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == _CLAIM:
                    yield _batch([tuple(r.values())])
                else:
                    (new if r["kind"] == _NEW else runs).append(r)
        h, c, doc, pos, n = _read(new, _COLUMNS[:5])
        o = np.lexsort((pos, doc, c, h))
        h, c, doc, pos, n = h[o], c[o], doc[o], pos[o], n[o]
        out, lead = _leads(h, c)
        later = (doc != doc[lead]) | (pos != pos[lead])
        rows = list(_claims(doc[later], pos[later], n[later], doc[lead][later], pos[lead][later], buckets))
        h, c, doc, pos, n = h[out], c[out], doc[out], pos[out], n[out]
        # merge join: of each sorted run, what has a fingerprint of the batch
        met = []
        for r in runs:
            own = _read([r], _COLUMNS[:5])
            # what the batch holds of a hot fingerprint may be in any bucket
            keep = np.isin(own[0], hot)
            if len(h):
                at = np.searchsorted(h, own[0])
                keep |= (at < len(h)) & (h[np.minimum(at, len(h) - 1)] == own[0])
            met.append([x[keep] for x in own])
        old = [np.concatenate(x) for x in zip(*met, strict=True)] if met else [x[:0] for x in (h, c, doc, pos, n)]
        # old entries before new ones: where all words are known, the batch's entry is a claim
        age = np.concatenate([np.zeros(len(old[0]), bool), np.ones(len(h), bool)])
        h, c, doc, pos, n = (np.concatenate(x) for x in zip(old, (h, c, doc, pos, n), strict=True))
        o = np.lexsort((pos, doc, age, c, h))
        h, c, doc, pos, n, age = (x[o] for x in (h, c, doc, pos, n, age))
        first, lead = _leads(h, c)
        known = ~first & age
        rows += _claims(doc[known], pos[known], n[known], doc[lead][known], pos[lead][known], buckets)
        h, c, doc, pos, n, age = (x[first] for x in (h, c, doc, pos, n, age))
        # a fingerprint that several entries have, one of them new: their windows have to be looked at
        group = np.cumsum(_leads(h)[0]) - 1 if len(h) else np.zeros(0, np.int64)
        look = (np.bincount(group) > 1)[group] & (np.bincount(group, age) > 0)[group] | np.isin(h, hot)
        if look.any():
            rows.append((_PLACE, key[0].as_py(), None, None, K.pack(doc[look]), K.pack(pos[look]), K.pack(n[look]), None, None))
        rows += _packed(_RUN, np.full(int(age.sum()), key[0].as_py()), h=h[age], c=c[age], doc=doc[age], pos=pos[age], n=n[age])
        if rows:
            yield _batch(rows)

    return rows.groupBy("bucket").applyInArrow(merge, _ROW)


def _compacted(runs: list[DataFrame], buckets: int, hot: np.ndarray) -> DataFrame:
    """One run of several. Their entries differ, so they are only brought into one order."""

    def merge(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, doc, pos, n = _read([r for b in batches for r in b.to_pylist()], _COLUMNS[:5])
        o = np.lexsort((c, h))
        yield _batch(list(_packed(_RUN, np.full(len(h), key[0].as_py()), h=h[o], c=c[o], doc=doc[o], pos=pos[o], n=n[o])))

    rows = _dealt(runs[0], buckets, hot)
    for r in runs[1:]:
        rows = rows.union(_dealt(r, buckets, hot))
    return runtime.cut(rows.groupBy("bucket").applyInArrow(merge, _ROW), "run")


@dataclass
class Run:
    tier: int
    rows: DataFrame


class FingerprintIndex:
    """Sorted runs on the shared storage; add() takes documents that all come after those already in it."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, fan: int = FAN):
        self.spark, self.window, self.fan, self.n_docs = spark, window, fan, 0
        self.runs: list[Run] = []
        self.hot = np.zeros(0, np.uint64)

    def add(self, docs: DataFrame) -> DataFrame:
        """What the batch has in common with itself and with all earlier ones, for repeats(); the index then knows the batch."""
        runtime.ship(self.spark)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.n_docs += docs.count()
        buckets = max(16, self.n_docs // BUCKET_DOCS)
        hot = hot_fingerprints(docs, self.window)
        self.hot = np.union1d(self.hot, hot)
        rows = _scan(docs, self.window, buckets, hot)
        for r in self.runs:
            rows = rows.union(_dealt(r.rows, buckets, hot))
        found = runtime.cut(_merge_join(rows, buckets, hot), "run")
        self.runs.append(Run(0, found))
        self.compact(buckets)
        return found.where(f"kind <> {_RUN}")

    def compact(self, buckets: int) -> None:
        """Tier by tier: as soon as there are fan runs of a tier they become one of the next."""
        tier = 0
        while len(own := [r for r in self.runs if r.tier == tier]) >= self.fan:
            merged = Run(tier + 1, _compacted([r.rows for r in own], buckets, self.hot))
            self.runs = [r for r in self.runs if r.tier != tier] + [merged]
            tier += 1


def _window_claims(found: DataFrame, base: DataFrame, window: int, buckets: int) -> DataFrame:
    """Claims of single windows, from the places that entries with one fingerprint have."""

    def places(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(K.unpack(r["doc"], np.int64)), pa.array(K.unpack(r["pos"], np.uint32).astype(np.int64)), pa.array(K.unpack(r["n"], np.uint32).astype(np.int64))], names=["d", "pos", "n"])

    # several batches may ask for one place
    at = found.where(f"kind = {_PLACE}").mapInArrow(places, "d long, pos long, n long").distinct().groupBy("d").agg(F.collect_list("pos").alias("pos"), F.collect_list("n").alias("n"))

    def flush(parts) -> pa.RecordBatch:
        h, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.lexsort((pos, doc, h))
        h, doc, pos = h[o], doc[o], pos[o]
        new, lead = _leads(h)
        later = (doc != doc[lead]) | (pos != pos[lead])
        rows = list(_claims(doc[later], pos[later], np.ones(int(later.sum()), np.int64), doc[lead][later], pos[lead][later], buckets))
        rows += _packed(_NEW, _bucket_of(h[new], buckets), h=h[new], doc=doc[new], pos=pos[new])
        return _batch(rows)

    def windows(batches):
        parts, size = [], 0
        for batch in batches:
            d, pos, n = (batch.column(c) for c in ("doc_id", "pos", "n"))
            for a, b, buf, offs in K.slices(batch.column("text")):
                w = K.Words(buf, offs, K.WHITE, False)
                h = K.rolling(w.h, window, 0xB0B)
                sizes = np.diff(pos.slice(a, b - a).offsets.to_numpy())
                row = np.repeat(np.arange(b - a), sizes)
                first, count = (x.slice(a, b - a).flatten().to_numpy() for x in (pos, n))
                row = np.repeat(row, count)
                first = np.repeat(first, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                # of rows that repeat a doc_id, one may have fewer words
                ok = first + window <= w.counts()[row]
                row, first = row[ok], first[ok]
                parts.append((h[w.first[row] + first], d.slice(a, b - a).to_numpy()[row], first))
                size += len(row)
                if size >= GATHER:
                    yield flush(parts)
                    parts, size = [], 0
        if size:
            yield flush(parts)

    def merge(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == _CLAIM:
                    yield _batch([tuple(r.values())])
                else:
                    new.append(r)
        h, doc, pos = _read(new, ("h", "doc", "pos"))
        if len(h):
            o = np.lexsort((pos, doc, h))
            h, doc, pos = h[o], doc[o], pos[o]
            _, lead = _leads(h)
            later = (doc != doc[lead]) | (pos != pos[lead])
            if later.any():
                yield _batch(list(_claims(doc[later], pos[later], np.ones(int(later.sum()), np.int64), doc[lead][later], pos[lead][later], buckets)))

    rows = base.join(at.hint("shuffle_hash"), F.col("doc_id") == F.col("d")).select("doc_id", "text", "pos", "n")
    return rows.mapInArrow(windows, _ROW).groupBy("bucket").applyInArrow(merge, _ROW)


def _segments(claims: DataFrame, window: int) -> DataFrame:
    """d, s, n, src, at: n words of document d from word s on are those of document src from word at on; claims that meet on a diagonal are one."""

    def merge(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, pos, n, src, at = _read([r for b in batches for r in b.to_pylist()], _COLUMNS[2:])
        pos, n, at = (x.astype(np.int64) for x in (pos, n, at))
        diagonal = at - pos
        o = np.lexsort((pos, diagonal, src, doc))
        doc, pos, n, src, diagonal = doc[o], pos[o], n[o], src[o], diagonal[o]
        end = pos + n + window - 1
        same = np.zeros(len(doc), bool)
        same[1:] = (doc[1:] == doc[:-1]) & (src[1:] == src[:-1]) & (diagonal[1:] == diagonal[:-1])
        # the furthest end so far on the diagonal
        line = np.cumsum(~same) - 1
        far = np.maximum.accumulate(end + line * (1 << 34)) - line * (1 << 34)
        new = ~same
        new[1:] |= pos[1:] > far[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        cols = (doc[first], pos[first], far[last] - pos[first], src[first], pos[first] + diagonal[first])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["d", "s", "n", "src", "at"])

    return claims.groupBy("bucket").applyInArrow(merge, "d long, s long, n long, src long, at long")


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=20).digest()


def repeats(found: DataFrame, docs: DataFrame, history: DataFrame | None = None, window: int = WINDOW, with_text: bool = False, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row of docs: a batch, or several, of which add() gave found; history: the texts of all earlier ones."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets or max(16, own.count() // BUCKET_DOCS)
    every = own
    if history is not None:
        every = own.withColumn("own", F.lit(True)).union(history.select(F.col("doc_id").cast("long"), "text", F.lit(False)))
    every = every.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NONE)))
    # one exchange of the texts, which all three joins below read
    base = every.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    claims = found.where(f"kind = {_CLAIM}").union(_window_claims(found, base, window, buckets))
    segments = _segments(claims, window)

    def digests(batches):
        for batch in batches:
            out = {"src": [], "at": [], "n": [], "digest": []}
            for d, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                words = (text or "").encode().split()
                for x in spans:
                    if x["at"] + x["n"] <= len(words):
                        for name, v in zip(out, (d, x["at"], x["n"], _digest(words[x["at"] : x["at"] + x["n"]])), strict=True):
                            out[name].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c == "digest" else pa.int64()) for c, v in out.items()})

    spans = segments.select(F.col("src").alias("k"), "at", "n").distinct().groupBy("k").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    sources = base.join(spans.hint("shuffle_hash"), F.col("doc_id") == F.col("k")).select("doc_id", "text", "spans").mapInArrow(digests, "src long, at long, n long, digest binary")
    due = segments.join(sources.hint("merge"), ["src", "at", "n"]).groupBy("d").agg(F.collect_list(F.struct("s", "n", "digest")).alias("due"))
    rows = (base if history is None else base.where("own")).join(due.hint("shuffle_hash"), F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", "due")

    def apply(batches):
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
            for text, due in zip(batch.column("text").to_pylist(), batch.column("due").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n, go = len(words), np.zeros(len(words), bool)
                for x in due or ():
                    s, e = x["s"], x["s"] + x["n"]
                    if not go[s:e].all() and _digest(words[s:e]) == x["digest"]:
                        go[s:e] = True
                if go.any():
                    words = [w for w, g in zip(words, go.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                for x, v in zip(out.values(), (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None), strict=True):
                    x.append(v)
            ids = [None if d == _NONE else d for d in batch.column("doc_id").to_pylist()]
            cols = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
            if with_text:
                cols["kept_text"] = pa.array(out["kept_text"], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, fan: int = FAN, with_text: bool = False) -> DataFrame:
    """repeats() of a whole table, added to a new index in batches of ascending doc_id. The result doesn't depend on their number."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = FingerprintIndex(docs.sparkSession, window, fan)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    found = None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs
        if lo is not None:
            part = part.where(F.col("doc_id") > int(lo))
        if hi is not None:
            part = part.where((F.col("doc_id") <= int(hi)) | F.lit(lo is None) & F.col("doc_id").isNull())
        own = index.add(part)
        found = own if found is None else found.union(own)
    return repeats(found, docs, None, window, with_text, max(16, index.n_docs // BUCKET_DOCS))
