"""The methods themselves, held against plain Python that imports nothing of what it checks."""

import hashlib
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat_collapse, decontaminate, hash_tree, host_reputation, jaccard_join, kernels, line_dedup, packing, robust_quality, runtime, substring_dedup, token_store, tokens

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ITEM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode())


def item_words(t):
    return ITEM.findall((t or "").encode().lower())


@pytest.fixture(scope="module")
def corpus(sf):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module")
def medium():
    return [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


# operator 1


def stored(spark, rows, monkeypatch=None):
    target = runtime.fresh_path(spark, "store")
    return target, token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), target)


def change(spark, target, table, how):
    """The store with one table replaced by how(table)."""
    other = target + "-" + hashlib.md5(repr(how).encode()).hexdigest()
    for t in ("written", "recipes", "manifest", "groups", "head"):
        df = spark.read.parquet(f"{target}/{t}")
        df = how(df) if t == table else df
        (df.write.partitionBy("kind") if t == "written" else df.write).parquet(f"{other}/{t}")
    return other


def test_store_finds_every_change(spark, monkeypatch):
    monkeypatch.setattr(token_store, "PART_DOCS", 4)
    monkeypatch.setattr(token_store, "FAN", 2)
    rows = [(i, f"document {i} has its own words and {'some more ' * (i % 5)}") for i in range(20)] + [(None, "nameless"), (7, ""), (7, None)]
    target, root = stored(spark, rows)
    good = token_store.verify_store(spark, target, root).collect()
    assert len(good) == len(rows) and all(r.verified for r in good)
    assert not any(r.verified for r in token_store.verify_store(spark, target, b"0" * 16).collect())
    whole = spark.read.parquet(f"{target}/recipes")
    part = whole.where("doc_id = 10").first().part
    n_parts = whole.select("part").distinct().count()
    assert n_parts > 2
    # the parts of documents 10 and 11, which the changes below concern
    own = {r.doc_id for r in whole.join(whole.where("doc_id IN (10, 11)").select("part").distinct(), "part").collect()}
    swap = lambda df: df.withColumn("doc_id", F.expr("CASE doc_id WHEN 10 THEN 11 WHEN 11 THEN 10 ELSE doc_id END"))
    for how in (lambda df: df.where("doc_id IS NULL OR doc_id <> 10"), swap, lambda df: df.withColumn("doc_id", F.expr("CASE doc_id WHEN 10 THEN 99 ELSE doc_id END")), lambda df: df.withColumn("start", F.expr("start + CAST(doc_id <=> 10 AS INT)"))):
        got = token_store.verify_store(spark, change(spark, target, "recipes", how), root).collect()
        bad = {r.doc_id for r in got if not r.verified}
        assert bad and bad <= own | {99} and len([r for r in got if r.verified]) >= len(rows) - len(own) - 1
    gone = token_store.verify_store(spark, change(spark, target, "recipes", lambda df: df.where(f"part <> {part}")), root).collect()
    assert [r.doc_id for r in gone if not r.verified] == [None] and len(gone) == len(rows) - whole.where(f"part = {part}").count() + 1
    for table, how in (("manifest", lambda df: df.where(f"part <> {part}")), ("groups", lambda df: df.where("grp <> 0")), ("head", lambda df: df.withColumn("n_tokens", F.expr("n_tokens + 1"))), ("manifest", lambda df: df.withColumn("n_tokens", F.expr("n_tokens + CAST(part = 0 AS INT)")))):
        assert not any(r.verified for r in token_store.verify_store(spark, change(spark, target, table, how), root).collect()), table
    lost = spark.read.parquet(f"{target}/written").where("kind = 0").first().digest
    got = token_store.verify_store(spark, change(spark, target, "written", lambda df: df.where((F.col("kind") == 1) | (F.col("digest") != F.lit(bytes(lost))))), root).collect()
    assert len(got) == len(rows) and 0 < sum(not r.verified for r in got) < len(rows)


# operator 2


def shingles(t, k):
    w = WORD.findall((t or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rng, s, tried = np.random.default_rng(7), jaccard_join.Signatures(percent), 0
    usual = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    s.common = np.sort(usual)
    for _ in range(400):
        n = int(np.exp(rng.uniform(0, 6.5)))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        k = int(rng.uniform(0, 1.3) * min(n, 400))  # up to all shingles are common ones
        a[: min(k, n, 400)] = usual[: min(k, n, 400)]
        rng.shuffle(a)
        m = int(n * (100 - percent) / 100 * rng.uniform(0, 1.05))
        add = int(rng.integers(0, m + 1))
        a, b = np.unique(a), np.unique(np.concatenate([a[min(m - add, n - 1) :], rng.integers(0, 1 << 62, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            d, x = s.sign(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert set(x[d == 0].tolist()) & set(x[d == 1].tolist())
            tried += 1
    assert tried > 300


def regions_of(rows, k, percent):
    """Regions of the distinct sets, by the signatures, in plain Python."""
    texts = pa.array([t for _, t in rows], pa.string())
    owner, sets = {}, []
    for _, _, buf, offs in kernels.slices(texts):
        doc, h = kernels.shingle_sets(kernels.Words(buf, offs, kernels.WHITE, True), k)
        sets += [h[doc == d] for d in range(len(offs) - 1)]
    sets = [np.array(x, np.uint64) for x in {tuple(x.tolist()) for x in sets if len(x)}]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    n = np.array([len(x) for x in sets])
    doc, sig = jaccard_join.Signatures(percent).sign(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n)
    for d, x in zip(doc.tolist(), sig.tolist(), strict=True):
        a, b = find(owner.setdefault(x, d)), find(d)
        up[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(sets)):
        out.setdefault(find(i), []).append(sets[i])
    return [x for x in out.values() if len(x) > 1]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_pivots_make_the_links(medium, k, percent):
    regions = regions_of(medium, k, percent)
    done = {"pivots": 0, "cells": 0, "replicas": 0, "links": 0}
    for sets in regions:
        r = jaccard_join.Region(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), percent)
        r.solve()
        for c in done:
            done[c] += getattr(r, c)
    assert max(map(len, regions)) < 20 and done["pivots"] >= len(regions) and done["links"] > 0 and done["cells"] > 0
    # groups of near copies far enough apart for Voronoi cells, near enough that some members lie in two
    rng = np.random.default_rng(2)
    groups, sets = [np.concatenate([np.arange(30), 1000 * (g + 1) + np.arange(270)]) for g in range(6)], []
    for g, own in enumerate(groups):
        sets.append(np.unique(np.concatenate([own[:150], groups[(g + 1) % 6][150:]])).astype(np.uint64))
        for i in range(24):
            x = own.copy()
            x[rng.integers(0, 300, i)] = 100_000 * (g + 1) + 1000 * i + rng.integers(0, 900, i)
            sets.append(np.unique(x).astype(np.uint64))
    r = jaccard_join.Region(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), percent)
    root = r.solve()
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert root.tolist() == up and r.cells > 0 and r.replicas > 0 and r.links > 0


def test_large_regions_equal_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base, rows = [[f"w{g}x{i}" if i >= 150 - 30 * g else f"w{i}" for i in range(150)] for g in range(4)], []
    for i in range(260):
        w = list(base[i % 4])
        for j in rng.integers(0, 150, rng.integers(0, 6)):
            w[j] = f"x{rng.integers(0, 10**9)}"
        rows.append((i if i % 50 else 10**6, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "LARGE_PART", 20)
    want = sorted(map(tuple, jaccard_join.jaccard_components(df, 3, 80, region_rows=10**6).collect()))
    assert sorted(map(tuple, jaccard_join.jaccard_components(df, 3, 80, region_rows=4).collect())) == want
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t, 3))
    up = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and up[a] != up[b] and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((up[a], up[b]))
                up = {d: lo if c == hi else c for d, c in up.items()}
    assert {d: c for d, _, c in want} == up


# operator 3


def removed(rows, window=20):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        w = words(t)
        go = [0] * len(w)
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i : i + window]), (d, i)) != (d, i):
                go[i : i + window] = [1] * window
        out[d] = (len(w), sum(go), hashlib.sha256(b" ".join(x for x, g in zip(w, go, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("sample, often", [(64, 32), (1, 2)])
def test_index_takes_batch_after_batch(spark, corpus, monkeypatch, sample, often):
    monkeypatch.setattr(substring_dedup, "SAMPLE", sample)
    monkeypatch.setattr(substring_dedup, "OFTEN", often)
    passage = " ".join(f"passage{i}" for i in range(70))
    rows = [(d, t) for d, t, *_ in corpus] + [(5000 + i, f"own{i} " * 25 + passage + f" tail{i}" * i) for i in range(12)]
    rows += [(6000, "a b " * 30), (6001, "a b " * 30 + "c"), (6002, None), (6003, "")]
    rows.sort()
    want = removed(rows)
    cut = [0, 60, 120, 205, len(rows)]
    index, history, sizes = substring_dedup.FingerprintIndex(spark, fan=3), None, []
    for lo, hi in zip(cut, cut[1:], strict=False):
        batch = spark.createDataFrame(rows[lo:hi], "doc_id long, text string")
        found = index.add(batch)
        got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.repeats(found, batch, history).collect()}
        assert got == {d: want[d] for d, _ in rows[lo:hi]}
        history = batch if history is None else history.union(batch)
        sizes.append([r.tier for r in index.runs])
    # the third run completes a tier, which is compacted; the fourth batch met the compacted run
    assert sizes == [[0], [0, 0], [1], [1, 0]]
    held = [r for run in index.runs for r in run.rows.where(f"kind = {substring_dedup._RUN}").collect()]
    n = sum(len(r.h) // 8 for r in held)
    windows = sum(max(0, len(words(t)) - 19) for _, t in rows)
    assert n > windows / 14  # nothing that is new is left out: a fingerprint for every 15 windows at least
    for r in held:
        h = kernels.unpack(bytes(r.h), np.uint64)
        assert (h[1:] >= h[:-1]).all()


def test_claims_are_verified_on_the_words(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    found = substring_dedup.FingerprintIndex(spark).add(rows)
    # a claim that documents 1 and 2 are equal, as a collision of hashes would make it
    false = list(substring_dedup._claims(np.array([2]), np.array([0]), np.array([21]), np.array([1]), np.array([0]), 16))
    found = found.union(spark.createDataFrame([tuple(None if x is None else x for x in r) for r in false], substring_dedup._ROW))
    assert {r.doc_id: r.n_removed for r in substring_dedup.repeats(found, rows, buckets=16).collect()} == {1: 0, 2: 0, 3: 40}


# operator 4


def patience(a, b):
    """Places of b that a patience diff of a and b aligns, with their places in a; recursive, from the definition."""

    def diff(i0, i1, j0, j1):
        if i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            return [(i0, j0)] + diff(i0 + 1, i1, j0 + 1, j1)
        if i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            return diff(i0, i1 - 1, j0, j1 - 1) + [(i1 - 1, j1 - 1)]
        x, y = a[i0:i1], b[j0:j1]
        once = [(i0 + x.index(v), j0 + y.index(v)) for v in x if x.count(v) == 1 and y.count(v) == 1]
        best = []  # best[k]: the rising chain of k + 1 pairs that ends lowest
        for i, j in once:
            k = next((k for k, c in enumerate(best) if c[-1][1] >= j), len(best))
            chain = [*(best[k - 1] if k else []), (i, j)]
            best[k : k + 1] = [chain]
        if not best:
            return []
        out, i, j = [], i0, j0
        for p, q in best[-1]:
            out += [*diff(i, p, j, q), (p, q)]
            i, j = p + 1, q + 1
        return out + diff(i, i1, j, j1)

    return diff(0, len(a), 0, len(b))


def weigh(line):
    return max(len(words(line)), len(re.findall("[\u3000-\u9fff\u0e00-\u0eff]", line)) // 2)


def runs(seq):
    """(first, last) of the shortest runs from a line on, or up to a line, that have five words."""
    n = [weigh(x) for x in seq]
    total = lambda i, j: sum(n[i : j + 1])
    up = {(i, min(e)) for i in range(len(n)) if (e := [j for j in range(i, len(n)) if total(i, j) >= 5])}
    return up | {(max(b), j) for j in range(len(n)) if (b := [i for i in range(j + 1) if total(i, j) >= 5])}


def lines_removed(rows, rare=20):
    """doc -> text without the blocks that an earlier document aligns and that have five words, or that are a whole copy, or a run of very many documents."""
    out, seqs, held = [], [], {}
    for d, t in {(d, t) for d, t in rows if d is not None}:
        seq = [x for x in (t or "").split("\n") if x]
        for run in {tuple(seq[i : j + 1]) for i, j in runs(seq)}:
            held.setdefault(run, []).append(d)
    for d, t in rows:
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if x]
        seq, gone = [lines[i] for i in at], set()
        for i, j in runs(seq):
            own = held[tuple(seq[i : j + 1])]
            if len(own) > rare and min(own) < d:
                gone.update(at[i : j + 1])
        for e, other in seqs:
            if e >= d or not set(other) & set(seq):
                continue
            if other == seq:
                gone.update(at)
                continue
            block = []
            for i, j in [*patience(other, seq), (-9, -9)]:
                if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                    if sum(weigh(seq[q]) for _, q in block) >= 5:
                        gone.update(at[q] for _, q in block)
                    block = []
                block.append((i, j))
        seqs.append((d, seq))
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


@pytest.mark.parametrize("rare", [20, 3, 10**9])
def test_lines_equal_an_independent_alignment(spark, corpus, monkeypatch, rare):
    monkeypatch.setattr(line_dedup, "RARE", rare)
    rng = np.random.default_rng(9)
    pool = [f"line {i} of {'many ' * (i % 4)}words" for i in range(9)] + ["a", "", "b c"]
    rows = [(d, t) for d, t, *_ in corpus] + [(9000 + i, "\n".join(pool[j] for j in rng.integers(0, len(pool), rng.integers(1, 9)))) for i in range(80)] + [(9990, None), (9991, "x\n\ny z\n\nu v"), (9992, "x\n\ny z\n\nu v")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), every=True)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, lines_removed(sorted(rows, key=lambda r: r[0]), rare)))
    assert dict(lines_removed(rows, rare))[9992] == "\n"  # empty lines stay


# operators 5, 6, 9: names, repeats and nulls


def test_extra_columns_may_clash(spark):
    c = spark.createDataFrame([(1, 0, "u", "a", 1, "x"), (1, 1, "b", "c", 2, "y"), (2, 0, "u", "a", 3, "z")], "conv_id long, turn long, role string, text string, idx int, h1 string")
    assert [(r.conv_id, r.n_turns) for r in chat_collapse.render(c).collect()] == [(1, 2)]
    p = spark.createDataFrame([(1, "http://u:p@a.co.uk:80/x", 5, "q"), (1, "http://u:p@a.co.uk:80/x", 6, "r"), (None, None, 7, "s")], "page_id long, url string, n int, host string")
    lab = spark.createDataFrame([(1, 0, 0, 4)], "doc_id long, quality int, toxic int, bad int")
    got = host_reputation.judge_urls(p, lab).collect()
    assert sorted((r.page_id or 0, r.host, r.n_labelled, r.n_bad) for r in got) == [(0, "", 0, 0), (1, "u:p@a.co.uk:80", 2, 2), (1, "u:p@a.co.uk:80", 2, 2)]
    d = spark.createDataFrame([(None, "t", 1, 2), (None, "t", 1, 2), (5, None, 1, 2), (5, None, 1, 2)], "doc_id long, text string, shard int, block int")
    got = hash_tree.shard_documents(d).collect()
    assert len(got) == 4 and len({(r.shard, r.slot) for r in got}) == 4 and {(r.doc_id, r.size, r.text_crc32) for r in got} == {(None, 2, zlib.crc32(b"t")), (5, 1, 0)}


def test_registered_domains(spark):
    hosts = ["a.b.example.com", "x.co.uk", "www.x.co.uk", "y.co.uk", "co.uk", "10.1.2.3", "u@10.1.2.3:80", "u:p@www.x.org:8080", "localhost", "", "[::1]:80", "a.user.github.io"]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select(*host_reputation.host_levels(F.col("host"))).collect()
    assert [tuple(r) for r in got] == [("example.com", "com"), ("x.co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("y.co.uk", "co.uk"), ("co.uk", "co.uk"), ("10.1.2.3", ""), ("10.1.2.3", ""), ("x.org", "org"), ("localhost", "localhost"), ("", ""), ("[::1]", ""), ("user.github.io", "github.io")]


# operator 7


def plain_packer(lengths, capacity, most):
    """(bin, offset) by a list of open bins: the tightest that fits, the one closed last of equal ones; the fullest closes."""
    open_, made, out, closed = [], 0, [], 0  # [free, serial, bin]
    for serial, n in enumerate(lengths):
        fits = [b for b in open_ if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], -b[1]))
            open_.remove(b)
        else:
            b, made = [capacity, serial, made], made + 1
        out.append((b[2], capacity - b[0]))
        b[0], b[1] = b[0] - n, serial
        if b[0]:
            open_.append(b)
            if len(open_) > most:
                open_.remove(min(open_, key=lambda b: (b[0], -b[1])))
                closed += 1
    return out, closed


def test_packing_is_online_and_bounded(spark, medium):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in np.minimum(2048, rng.lognormal(6, 1, 3000) + 1)]
    fit = packing.BestFit(2048, packing.OPEN)
    placed = [fit.place(x) for x in lengths]
    want, closed = plain_packer(lengths, 2048, packing.OPEN)
    assert placed == want and fit.closed == closed
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1)
    got = packing.pack_documents(df, most_open=16).collect()
    path, rows = tokens.vocabulary_path(), []
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    for d, t in [tuple(r) for r in df.collect()]:
        n = len(tk.encode(t or "", add_special_tokens=False).ids) + 1
        rows += [(d, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))]
    want, closed = plain_packer([r[2] for r in rows], 2048, 16)
    assert closed > 0
    assert sorted((r.doc_id, r.piece, r.length, r.sequence_id, r.offset) for r in got) == sorted((*r, *p) for r, p in zip(rows, want, strict=True))


def test_packing_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3 + [(None, None)] * 4, "doc_id long, text string").repartition(2)
    got = packing.pack_documents(df).collect()
    assert len(got) == 7 and len({(r.sequence_id, r.offset) for r in got}) == 7 and {r.length for r in got if r.doc_id is None} == {1}


# operator 8


def test_suffix_order_is_a_suffix_array():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, 400).astype(np.uint32)
    ends = np.zeros(400, bool)
    ends[[50, 51, 200, 399]] = True
    run = decontaminate._runs(x, ends)
    starts = np.flatnonzero(run)
    suffix = lambda s: tuple(x[s : s + run[s]].tolist())
    assert [int(s) for s in decontaminate.suffix_order(x, run, starts, 400)] == sorted(starts.tolist(), key=lambda s: (suffix(s), s))


def matches(rows, items, window=13):
    """Longest matches of at least a window: per document (words, start, item, place), and per item suffix its words."""
    by_doc, by_suffix = {}, {}
    for d, t in rows:
        w, best = item_words(t), (0, -1, None, -1)
        for i, text in items:
            v = item_words(text)
            need = min(window, len(v))
            at = {}
            for q in range(len(v) - need + 1 if need else 0):
                at.setdefault(tuple(v[q : q + need]), []).append(q)
            for p in range(len(w) - need + 1 if need else 0):
                for q in at.get(tuple(w[p : p + need]), ()):
                    n = need
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    best = min(best, (n, p, str(i), q), key=lambda r: (-r[0], r[1], r[2] or "", r[3]))
                    by_suffix[str(i), q] = max(by_suffix.get((str(i), q), 0), n)
        by_doc[d] = best
    return by_doc, by_suffix


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 1500])
def test_longest_matches(spark, corpus, sf, block):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    items += [(800, " ".join(f"q{i}" for i in range(40))), (801, " ".join(f"q{i}" for i in range(20, 60))), (802, "five words in one item"), (803, corpus[3][1]), (804, None)]
    rows = [(d, t) for d, t, *_ in corpus] + [(7000, " ".join(f"q{i}" for i in range(10, 35)) + " x " + " ".join(f"q{i}" for i in range(22, 50))), (7001, "five words in one item and more"), (7002, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    by_doc, by_suffix = matches(rows, items)
    got = decontaminate.contamination(docs, bench, block_bytes=block)
    assert {r.doc_id: (r.longest_words, r.longest_start, r.longest_item, r.longest_item_start) for r in got.collect()} == by_doc
    assert by_doc[7000] == (28, 26, "801", 2) and by_doc[7001] == (5, 0, "802", 0)
    texts, by_item = dict(rows), dict((str(i), t) for i, t in items)
    seen = {}
    for r in decontaminate.longest_matches(docs, bench, block_bytes=block).collect():
        seen[r.item_id, r.item_start] = r.words
        assert item_words(texts[r.doc_id])[r.doc_start : r.doc_start + r.words] == item_words(by_item[r.item_id])[r.item_start : r.item_start + r.words]
    assert seen == by_suffix
    clash = docs.withColumn("__hit_mask", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("mask", F.lit(3))
    kept = decontaminate.keep_clean(clash, bench, block_bytes=block)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.where("NOT contaminated").collect()}


# operator 10


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeat = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(repeat)


FLOOR = np.array([0.5, 0.08, 0.06, 0.15])


def moments(x, factor):
    x = np.array(x)
    m = x.mean(axis=0)
    c = ((x[:, :, None] * x[:, None, :]).mean(axis=0) - np.outer(m, m)) * factor
    for i in range(4):
        c[i, i] = max(max(c[i, i], 0) + FLOOR[i] ** 2 / 4, FLOOR[i] ** 2)
    return m, c


def distance(x, m, c):
    return np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)


def mcd(x):
    """Median start, C-steps to a stable half, reweighting: (documents used, mean, covariance)."""
    bins = np.floor(np.minimum(x * 10_000, 400_000) / 100)
    q = [np.sort(bins, axis=0)[int(np.ceil(len(x) * s)) - 1] for s in (0.25, 0.5, 0.75)]
    m, c = (q[1] + 0.5) / 100, np.diag(np.maximum((q[2] - q[0]) / 100 / 1.349, FLOOR) ** 2)
    before = None
    for _ in range(8):
        b = np.minimum(np.floor(np.log1p(distance(x, m, c)) * 200), 8191)
        edge = np.sort(b)[int(np.ceil(len(x) * 0.5)) - 1]
        half = b <= edge
        m, c = moments(x[half], 2.1)
        if before is not None and (half == before).all():
            break
        before = half
    near = distance(x, m, c) <= 18.47
    return int(near.sum()), *moments(x[near], 1.0)


def verdicts(rows):
    """doc -> kept, by numpy."""
    stats = {d: base(t) for d, t, *_ in rows}
    ok = {d: n >= 10 and 100 * r <= 20 * n for d, (n, _, _, r) in stats.items()}
    vec = {d: np.round(np.array([np.log(max(n, 1)), np.log((c + 275.0) / (n + 50)), np.sqrt(s / max(n, 1)), np.sqrt(r / max(n, 1))]) * 10_000) / 10_000 for d, (n, c, s, r) in stats.items()}

    @lru_cache(maxsize=None)
    def group(*key):
        x = [vec[d] for d, _, lang, source, *_ in rows if ok[d] and (lang, source)[: len(key)] == key]
        n, m, c = mcd(np.array(x)) if x else (0, np.zeros(4), np.zeros((4, 4)))
        if not key:
            return m, c
        up, share = group(*key[:-1]), n / (n + 50.0)
        return share * m + (1 - share) * up[0], share * c + (1 - share) * up[1]

    return {d: bool(ok[d] and distance(vec[d][None], *group(lang, source))[0] <= 36.0) for d, _, lang, source, *_ in rows}


@pytest.fixture(scope="module")
def odd(corpus):
    """The corpus with sources of one, three and many documents, and junk in each."""
    rng = np.random.default_rng(5)
    prose = lambda k: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(k))
    more = [(2000 + i, prose(60 + i), "xx", "many") for i in range(120)] + [(2200 + i, prose(90), "xx", "few") for i in range(3)] + [(2300, prose(80), "xx", None), (2301, prose(80), None, "alone")]
    more += [(2400 + i, " ".join(f"{i}### $$a{j}" for j in range(40)), "xx", s) for i, s in enumerate(("many", "few", "one", None))] + [(2500, None, "xx", "many"), (2501, "", None, None)]
    return [*corpus, *((d, t, x, s, None if t is None else len(t)) for d, t, x, s in more)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_verdicts_equal_numpy(spark, odd):
    got = {r.doc_id: r.kept for r in robust_quality.quality_verdicts(frame(spark, odd)).collect()}
    want = verdicts(odd)
    assert got == want
    # junk is found in sources of every size, prose is kept in them
    assert not any(got[2400 + i] for i in range(4)) and all(got[d] for d in (*range(2200, 2203), 2300, 2301))


# the pipeline


def test_every_stage_against_plain_python(spark, odd, sf):
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    docs = frame(spark, odd).withColumn("__gone", F.lit("x")).withColumn("__row", F.lit(1)).withColumn("key", F.lit(2)).withColumn("mask", F.lit(None).cast("string"))
    rows, columns = odd, docs.columns

    def take(df):
        assert df.columns == columns and df.schema["text"].dataType == docs.schema["text"].dataType
        return runtime.cut(df, "test")

    kept = verdicts(rows)
    docs = take(stages["quality rules"](spark, docs, sf))
    rows = [r for r in rows if kept[r[0]]]
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in rows)

    docs = take(stages["line dedup"](spark, docs, sf))
    after = dict(lines_removed(sorted((r[0], r[1]) for r in rows)))
    rows = [(d, after[d], *rest) for d, t, *rest in rows if after[d] == t or words(after[d])]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == sorted((r[0], r[1], len(r[1])) for r in rows)

    docs = take(stages["n-gram Jaccard join"](spark, docs, sf))
    sets, comp = {r[0]: shingles(r[1], 5) for r in rows}, {r[0]: r[0] for r in rows}
    for a in sets:
        for b in sets:
            if a < b and comp[a] != comp[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {d: lo if c == hi else c for d, c in comp.items()}
    rows = [r for r in rows if comp[r[0]] == r[0]]
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in rows)

    docs = take(stages["benchmark decontamination"](spark, docs, sf))
    windows = set()
    for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist():
        w = item_words(r["text"])
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    clean = []
    for r in rows:
        w = item_words(r[1])
        hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.append(r)
    assert len(clean) < len(rows) and sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in clean)

    from tokenizers import Tokenizer

    tk, want = Tokenizer.from_file(tokens.vocabulary_path()), set()
    for d, t, *_ in clean:
        ids = tk.encode(t, add_special_tokens=False).ids + [0]
        want |= {(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    out = stages["best-fit packing"](spark, docs, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)


def test_stages_of_an_empty_table_and_of_nulls(spark, sf):
    import corpus_pipeline as P

    none = frame(spark, [(1, "a", "b", "c", 1)]).where("false").withColumn("__hit_mask", F.lit(1))
    nulls = frame(spark, [(None, None, None, None, None), (1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (3, " \n\n\t ", None, None, 5)]).withColumn("__hit_mask", F.lit(1))
    keep = {"quality rules": 0, "line dedup": 5, "n-gram Jaccard join": 5, "benchmark decontamination": 5, "best-fit packing": 5}
    for name, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0, name
        assert len(stage(spark, nulls, sf).collect()) == keep[name], name


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Bare:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            applicationId = "none"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(name, other):
                return other

    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_base(Bare)
    Bare.sparkContext.master = "local[2]"
    assert runtime.shared_base(Bare).startswith("file://") and json.dumps(runtime.shared_base(Bare))
