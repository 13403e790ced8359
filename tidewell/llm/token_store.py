"""Content-addressed store of token ids.

A document's ids (with an end id) are cut where a rolling hash over WINDOW ids has its low MASK_BITS at zero, so equal
passages cut alike wherever they stand; a chunk is named by the blake2b digest of its ids and stored once. Layout:

  written/kind=0   digest, n, body     ids as byte planes of 16-bit (or 32-bit) integers, dealt by digest (kind=1: recipes as they came)
  recipes/  doc_id, part, start, n_tokens, root, digests, counts     ascending doc_id; start counts from the part's first id
  manifest/ part, start, n_tokens, n_documents, root                 ids before the part; Merkle root of its documents
  groups/   grp, start, n_tokens, n_parts, root                      the same for FAN parts each
  head/     n_groups, n_tokens, root                                 one row: the root of the store, which write_store() returns

The root of a document is the Merkle root of its chunk digests; that of a part is over doc_id, start, length and root of
its documents in order; that of a group over its parts' rows, that of the store over its groups' rows. verify_store()
recomputes all of them: each chunk's digest from its bytes, each document's root, each part's root, counts and places
from its recipes, each group from the manifest, and the head from the groups. So a lost, added, altered or swapped row of
any table makes the rows that it concerns unverified: those of the part, or all rows where the tables above it or the
root that the caller holds don't agree. A document's crc32 is combined from the crc32 of its chunks' bytes (crc32 is
linear), so checking a whole store moves a few bytes a chunk and never the ids; read_documents() returns the ids themselves.

Defined results: null or empty text is the end id alone; rows without a doc_id come first; rows that repeat are stored
as rows of their own (their chunks once); an empty table gives an empty store; other columns of docs aren't read. A part
whose recipes are lost gives one unverified row without a doc_id.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import runtime, tokens

WINDOW = 16
MASK_BITS = 8
MOST = 4096
DIGEST = 16
#: Documents for each recipe part and for each chunk part.
PART_DOCS = 8192
#: Parts for each group of the manifest.
FAN = 4096
_SEEN = 500_000
_WRITTEN = "digest binary, n long, body binary, doc_id long, counts binary, kind int"
_RECIPES = "doc_id long, part int, start long, n_tokens long, root binary, digests binary, counts binary"
_MANIFEST = "part int, start long, n_tokens long, n_documents long, root binary"
_GROUPS = "grp int, start long, n_tokens long, n_parts long, root binary"
_HEAD = "n_groups long, n_tokens long, root binary"


def cut_points(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Chunk boundaries of documents laid end to end, document ends included."""
    h = K.rolling(ids, WINDOW, 0x51ED)
    at = np.flatnonzero((h & K.U((1 << MASK_BITS) - 1)) == 0) + WINDOW
    doc = np.searchsorted(offs, at - 1, "right") - 1
    at = at[at - WINDOW >= offs[doc]] if len(at) else at
    cuts = np.unique(np.concatenate([offs, at]))
    gaps = np.diff(cuts)
    if len(gaps) and gaps.max() > MOST:
        more = (gaps - 1) // MOST
        which = np.repeat(np.arange(len(gaps)), more)
        step = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + 1
        cuts = np.unique(np.concatenate([cuts, cuts[which] + step * MOST]))
    return cuts


def digest(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(ids, "<u4").tobytes(), digest_size=DIGEST).digest()


def digests(ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """digest() of each chunk between two cuts."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
    at = (4 * cuts).tolist()
    return [hashlib.blake2b(raw[i:j], digest_size=DIGEST).digest() for i, j in zip(at, at[1:], strict=False)]


def merkle(leaves: list[bytes]) -> bytes:
    if not leaves:
        return bytes(DIGEST)
    while len(leaves) > 1:
        leaves = [hashlib.blake2b(b"".join(leaves[i : i + 2]), digest_size=DIGEST).digest() for i in range(0, len(leaves), 2)]
    return leaves[0]


def leaf(*fields: int | bytes | None) -> bytes:
    """The digest of a row of numbers and digests."""
    parts = [b"-" if x is None else b"#" + int(x).to_bytes(8, "little", signed=True) if not isinstance(x, bytes) else b"=" + x for x in fields]
    return hashlib.blake2b(b"".join(parts), digest_size=DIGEST).digest()


def _parts(recipes: DataFrame) -> DataFrame:
    """part, n_tokens, n_documents, root, gapless of the recipes; a part has about PART_DOCS rows."""

    def root(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("start")
        n = t.column("n_tokens").to_numpy()
        leaves = [leaf(*r) for r in zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "root")), strict=True)]
        gapless = bool((t.column("start").to_numpy() == np.cumsum(n) - n).all())
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "n_tokens": [int(n.sum())], "n_documents": [len(t)], "root": [merkle(leaves)], "gapless": [gapless]})

    return recipes.select("part", "doc_id", "start", "n_tokens", "root").groupBy("part").applyInArrow(root, "part int, n_tokens long, n_documents long, root binary, gapless boolean")


def _groups(parts: DataFrame) -> list[tuple[int, int, int, bytes]]:
    """(grp, n_tokens, n_parts, root) of FAN parts each, ascending: a row for every FAN * PART_DOCS documents."""

    def root(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("part")
        leaves = [leaf(*r) for r in zip(*(t.column(c).to_pylist() for c in ("part", "n_tokens", "n_documents", "root")), strict=True)]
        yield pa.RecordBatch.from_pydict({"grp": pa.array([key[0].as_py()], pa.int32()), "n_tokens": [sum(t.column("n_tokens").to_pylist())], "n_parts": [len(t)], "root": [merkle(leaves)]})

    rows = parts.selectExpr(f"CAST(part DIV {FAN} AS INT) AS grp", "part", "n_tokens", "n_documents", "root").groupBy("grp").applyInArrow(root, "grp int, n_tokens long, n_parts long, root binary").collect()
    return sorted((r.grp, r.n_tokens, r.n_parts, bytes(r.root)) for r in rows)


def _head(groups: list[tuple[int, int, int, bytes]]) -> bytes:
    return merkle([leaf(*g) for g in groups])


def _placed(parts: DataFrame, groups: list[tuple[int, int, int, bytes]]) -> DataFrame:
    """parts with start, the ids before each: running sums inside a group behind the sums of the groups."""
    ends = np.cumsum([0, *(g[1] for g in groups)]).tolist()
    first = parts.sparkSession.createDataFrame([(g[0], at) for g, at in zip(groups, ends, strict=False)], "grp int, first long")
    rows = parts.withColumn("grp", F.expr(f"CAST(part DIV {FAN} AS INT)"))
    before = F.sum("n_tokens").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(first), "grp").withColumn("start", F.col("first") + F.col("before")).drop("grp", "first", "before")


def _store_ids(ids: np.ndarray) -> bytes:
    narrow = not len(ids) or ids.max() < 65536
    return (b"\2" if narrow else b"\4") + K.pack(ids.astype(np.uint16 if narrow else np.uint32))


def _bodies(ids: np.ndarray, cuts: np.ndarray, which: list[int]) -> list[bytes]:
    """_store_ids() of some chunks; the byte planes of narrow ids are made once for all."""
    at = cuts.tolist()
    if len(ids) and ids.max() >= 65536:
        return [_store_ids(ids[at[k] : at[k + 1]]) for k in which]
    low, high = (ids & 255).astype(np.uint8).tobytes(), (ids >> 8).astype(np.uint8).tobytes()
    return [b"\2" + low[at[k] : at[k + 1]] + high[at[k] : at[k + 1]] for k in which]


def load_ids(b: bytes) -> np.ndarray:
    return K.unpack(b[1:], np.uint16 if b[0] == 2 else np.uint32).astype(np.uint32)


def write_store(docs: DataFrame, target: str, path: str | None = None, end_id: int = 1) -> bytes:
    """Writes the store and returns its root."""
    spark = docs.sparkSession
    runtime.ship(spark)
    path = path or tokens.vocabulary_path()
    parts = max(4, docs.count() // PART_DOCS)

    def encode(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for a, b, buf, offs in K.slices(batch.column(1)):
                ids, at = tokens.with_end(*tokens.table(path).encode(buf, offs), end_id)
                cuts = cut_points(ids, at)
                names = digests(ids, cuts)
                sizes = np.diff(cuts)
                rows = {"kind": [], "digest": [], "n": [], "body": [], "doc_id": [], "counts": []}

                def add(*row, rows=rows):
                    for x, v in zip(rows.values(), row, strict=True):
                        x.append(v)

                fresh = []
                for k, name in enumerate(names):
                    if name not in seen:
                        seen.add(name)
                        fresh.append(k)
                rows["kind"] += [0] * len(fresh)
                rows["digest"] += [names[k] for k in fresh]
                rows["n"] += sizes[fresh].tolist()
                rows["body"] += _bodies(ids, cuts, fresh)
                rows["doc_id"] += [None] * len(fresh)
                rows["counts"] += [None] * len(fresh)
                if len(seen) > _SEEN:
                    seen.clear()
                first = np.searchsorted(cuts, at)
                for doc, (i, j) in zip(batch.column(0).slice(a, b - a).to_pylist(), zip(first, first[1:], strict=False), strict=True):
                    own = names[i:j]
                    add(1, merkle(own), int(sizes[i:j].sum()), b"".join(own), doc, K.pack(sizes[i:j].astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows.values(), (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=list(rows))

    def once(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for kind, name in zip(batch.column("kind").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                new = kind == 1 or name not in seen
                keep.append(new)
                if kind == 0:
                    seen.add(name)
            yield batch.filter(pa.array(keep))

    form = "kind int, digest binary, n long, body binary, doc_id long, counts binary"
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, form)
    spread = F.when(F.col("kind") == 0, F.xxhash64("digest")).otherwise(F.xxhash64("doc_id", "digest"))
    rows.withColumn("__key", spread).repartition(parts, "__key").drop("__key").mapInArrow(once, form).write.partitionBy("kind").option("compression", "zstd").parquet(f"{target}/written")

    staged = spark.read.schema(_WRITTEN).parquet(f"{target}/written").where("kind = 1")

    def place(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at), pa.array(n), batch.column("digest"), batch.column("body"), batch.column("counts")], names=["doc_id", "part", "start", "n_tokens", "root", "digests", "counts"])

    ordered = staged.repartitionByRange(parts, "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    ordered.mapInArrow(place, _RECIPES).write.parquet(f"{target}/recipes")

    parts = runtime.cut(_parts(spark.read.schema(_RECIPES).parquet(f"{target}/recipes")), "parts")
    groups = _groups(parts)
    _placed(parts, groups).select("part", "start", "n_tokens", "n_documents", "root").write.parquet(f"{target}/manifest")
    runtime.drop(parts)
    ends = np.cumsum([0, *(g[1] for g in groups)]).tolist()
    spark.createDataFrame([(g, at, n, k, r) for (g, n, k, r), at in zip(groups, ends, strict=False)], _GROUPS).coalesce(1).write.parquet(f"{target}/groups")
    spark.createDataFrame([(len(groups), ends[-1], _head(groups))], _HEAD).coalesce(1).write.parquet(f"{target}/head")
    return _head(groups)


def _raw(body: bytes) -> bytes | bytearray:
    """A chunk's ids as little-endian unsigned 32-bit integers; the byte planes of narrow ids go straight to their places."""
    if body[0] != 2 or len(body) % 2 == 0:
        return load_ids(body).astype("<u4").tobytes()
    n = len(body) // 2
    out = bytearray(4 * n)
    out[::4], out[1::4] = body[1 : n + 1], body[n + 1 :]
    return out


_POLY = 0xEDB88320


def _times(a: int, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo crc32's, bit-reversed."""
    out = np.zeros(len(b), np.uint32)
    b = b.astype(np.uint32)
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        if not a & (1 << i) - 1:
            break
        b = (b >> np.uint32(1)) ^ (b & np.uint32(1)) * np.uint32(_POLY)
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part's crc32 adds to the whole's when n_bytes follow it."""
    out, power = crc.astype(np.uint32), 1 << 23  # x ** 8
    left = n_bytes.astype(np.uint64)
    while left.any():
        odd = np.flatnonzero(left & np.uint64(1))
        out[odd] = _times(power, out[odd])
        power, left = int(_times(power, np.array([power], np.uint32))[0]), left >> np.uint64(1)
    return out


def _checked(spark: SparkSession, target: str, root: bytes | None) -> DataFrame:
    """part, before, found (its documents are there at all), sound: every part that the manifest or the recipes name."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{target}/manifest")
    groups = _groups(manifest)
    held = sorted(tuple(r) for r in spark.read.schema(_GROUPS).parquet(f"{target}/groups").collect())
    head = [tuple(r) for r in spark.read.schema(_HEAD).parquet(f"{target}/head").collect()]
    ends = np.cumsum([0, *(g[1] for g in groups)]).tolist()
    above = [(g, at, n, k, r) for (g, n, k, r), at in zip(groups, ends, strict=False)] == [(g, at, n, k, bytes(r)) for g, at, n, k, r in held]
    above = above and [(n, t, bytes(r)) for n, t, r in head] == [(len(groups), ends[-1], _head(groups))] and root in (None, _head(groups))
    own = _parts(spark.read.schema(_RECIPES).parquet(f"{target}/recipes")).select("part", *(F.col(c).alias(f"f_{c}") for c in ("n_tokens", "n_documents", "root")), "gapless")
    # one row per part, also where the manifest repeats one
    named = _placed(manifest, groups).withColumnRenamed("start", "due").join(manifest.select("part", "start"), "part")
    named = named.groupBy("part").agg(F.min("start").alias("before"), F.count("*").alias("times"), F.bool_and(F.col("start") == F.col("due")).alias("chained"), F.first("n_tokens").alias("n_tokens"), F.first("n_documents").alias("n_documents"), F.first("root").alias("root"))
    sound = F.expr("coalesce(times = 1 AND chained AND gapless AND n_tokens = f_tokens AND n_documents = f_documents AND root = f_root, false)") & F.lit(above)
    own = own.withColumnsRenamed({"f_n_tokens": "f_tokens", "f_n_documents": "f_documents"})
    return named.join(own, "part", "full").select("part", F.coalesce("before", F.lit(0)).alias("before"), F.col("f_root").isNotNull().alias("found"), sound.alias("sound"))


def verify_store(spark: SparkSession, target: str, root: bytes | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, verified: read from the files, a row per stored document. root: what write_store() returned."""
    runtime.ship(spark)

    def check(batches):
        for batch in batches:
            names, counts, crcs, good = batch.column("digest").to_pylist(), [], [], []
            for name, raw in zip(names, map(_raw, batch.column("body").to_pylist()), strict=True):
                counts.append(len(raw) // 4)
                crcs.append(zlib.crc32(raw))
                good.append(hashlib.blake2b(raw, digest_size=DIGEST).digest() == name)
            yield pa.RecordBatch.from_pydict({"digest": pa.array(names, pa.binary()), "n": pa.array(counts, pa.int64()), "crc": pa.array(crcs, pa.int64()), "good": pa.array(good, pa.bool_())})

    def steps(batches):
        for batch in batches:
            out = {"part": [], "at": [], "digest": [], "n": [], "after": [], "rooted": []}
            for part, at, root, names, counts in zip(*(batch.column(x).to_pylist() for x in ("part", "start", "root", "digests", "counts")), strict=True):
                own = [names[i : i + DIGEST] for i in range(0, len(names), DIGEST)]
                n = K.unpack(counts, np.uint32).astype(np.int64)
                out["part"] += [part] * len(own)
                out["at"] += [at] * len(own)
                out["digest"] += own
                out["n"] += n.tolist()
                out["after"] += (n.sum() - np.cumsum(n)).tolist()
                out["rooted"] += [merkle(own) == root] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=list(out))

    def shift(batches):
        for batch in batches:
            crc = shift_crc(batch.column("crc").to_numpy(), 4 * batch.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("at"), batch.column("n"), pa.array(crc.astype(np.int64)), batch.column("good")], names=["part", "at", "n", "crc", "good"])

    chunks = spark.read.schema(_WRITTEN).parquet(f"{target}/written").where("kind = 0").select("digest", "body").mapInArrow(check, "digest binary, n long, crc long, good boolean")
    recipes = spark.read.schema(_RECIPES).parquet(f"{target}/recipes")
    parts = runtime.cut(_checked(spark, target, root), "parts")
    used = recipes.select("part", "start", "root", "digests", "counts").mapInArrow(steps, "part int, at long, digest binary, n long, after long, rooted boolean")
    # a chunk that very many documents hold, like that of empty texts, is dealt over tasks
    often = runtime.cut(used.groupBy("digest").agg(F.count("*").alias("n")).where(f"n > {runtime.LEAST_PART}"), "often")
    found = runtime.meet(used, chunks.withColumnRenamed("n", "stored"), ["digest"], often, "at")
    found = found.select("part", "at", "n", "after", "crc", F.expr("rooted AND coalesce(good AND stored = n, false)").alias("good"))
    whole = found.mapInArrow(shift, "part int, at long, n long, crc long, good boolean").groupBy("part", "at").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("ids_crc32"), F.count("*").alias("n_chunks"), F.bool_and("good").alias("verified"))
    out = recipes.select("doc_id", "part", F.col("start").alias("at"), "n_tokens").join(whole, ["part", "at"], "left").join(parts.where("found"), "part")
    out = out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.expr("coalesce(sound AND verified AND n = n_tokens, false)").alias("verified"))
    lost = parts.where("NOT found").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "before AS start", "0L AS n_tokens", "0L AS ids_crc32", "0L AS n_chunks", "false AS verified")
    return out.union(lost)


def read_documents(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, ids): every stored document's ids, put together from its chunks."""
    recipes = spark.read.schema(_RECIPES).parquet(f"{target}/recipes")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{target}/manifest").select("part", F.col("start").alias("before"))

    def steps(batches):
        for batch in batches:
            out = {"part": [], "at": [], "doc_id": [], "k": [], "digest": []}
            for part, at, doc, names in zip(*(batch.column(x).to_pylist() for x in ("part", "start", "doc_id", "digests")), strict=True):
                for k in range(len(names) // DIGEST):
                    for x, v in zip(out.values(), (part, at, doc, k, names[k * DIGEST : (k + 1) * DIGEST]), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=list(out))

    def load(batches):
        for batch in batches:
            ids = [load_ids(b).astype(np.int64) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(ids, pa.list_(pa.int64()))], names=["digest", "ids"])

    runtime.ship(spark)
    chunks = spark.read.schema(_WRITTEN).parquet(f"{target}/written").where("kind = 0").select("digest", "body").mapInArrow(load, "digest binary, ids array<long>")
    used = recipes.mapInArrow(steps, "part int, at long, doc_id long, k int, digest binary")
    often = runtime.cut(used.groupBy("digest").agg(F.count("*").alias("n")).where(f"n > {runtime.LEAST_PART}"), "often")
    used = runtime.meet(used, chunks, ["digest"], often, "at")
    whole = used.groupBy("part", "at").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.expr("transform(array_sort(collect_list(struct(k, ids))), x -> x.ids)")).alias("ids"))
    return whole.join(manifest, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "ids")
