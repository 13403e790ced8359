import hashlib
import json
import re
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from tidewell.llm import chat_collapse, decontaminate, hash_tree, host_reputation, jaccard_join, line_dedup, packing, robust_quality, runtime, substring_dedup, token_store, tokens

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use themselves.
CLASH = "key string, bucket int, kind int, h long, mask binary, place string, doc int"


def words(t, lower=False):
    b = (t or "").encode()
    return WORD.findall(b.lower() if lower else b)


@pytest.fixture(scope="module")
def texts(sf):
    base = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    own = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in base]
    long = " ".join(f"Wort{i % 9000}" for i in range(30_000))
    shared = " ".join(f"shared{i}" for i in range(60))
    edge = [None, "", " \n\t ", "one", "two words", long, long + " end", "é\u00a0Ö ü<|endoftext|>x\u2003y", shared, "A B " + shared + " c\n" + shared, "x\x00y z"]
    return own + [(10_000 + i, t, None if i % 2 else "en", None if i % 3 else "src0") for i, t in enumerate(edge)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, x, s, None if t is None else len(t), "k", 1, 2, 3, b"m", "p", 9) for d, t, x, s in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH).repartition(3)


def empty(docs):
    return docs.where("false")


def test_token_store(spark, docs, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.vocabulary_path())
    target = runtime.fresh_path(spark, "store")
    token_store.write_store(docs.union(docs.where("doc_id = 10009")), target)
    got = sorted(map(tuple, token_store.verify_store(spark, target).select("doc_id", "start", "n_tokens", "ids_crc32", "verified").collect()))
    want, at = [], 0
    for d, t, *_ in sorted([*texts, *(x for x in texts if x[0] == 10_009)], key=lambda x: x[0]):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
        at += len(ids)
    assert got == sorted(want)
    back = {r.doc_id: list(r.ids) for r in token_store.read_documents(spark, target).collect()}
    assert all(back[d] == tk.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in texts)
    chunks = spark.read.parquet(f"{target}/written").where("kind = 0")
    assert chunks.count() == chunks.select("digest").distinct().count()
    none = runtime.fresh_path(spark, "store")
    token_store.write_store(empty(docs), none)
    assert token_store.verify_store(spark, none).count() == 0


def test_crc_shift():
    a, b = b"some bytes", b"and others that follow"
    assert int(token_store.shift_crc(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("top", [50, 49_408, 70_000])
def test_chunks_of_a_slice_are_named_and_stored_as_one_by_one(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 4000).astype(np.uint32)
    cuts = np.unique(np.concatenate([[0, 4000], rng.integers(0, 4000, 60)]))
    own = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    assert token_store.digests(ids, cuts) == [token_store.digest(x) for x in own]
    for x, body in zip(own[1::2], token_store._bodies(ids, cuts, list(range(1, len(own), 2))), strict=True):
        assert (token_store.load_ids(body) == x).all() and token_store._raw(body) == x.astype("<u4").tobytes()
    assert token_store._raw(token_store._store_ids(ids[:0])) == b""


def components(texts, k, percent):
    sets = {}
    for d, t, *_ in texts:
        w = words(t, True)
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, set()).add(d)
    for a, b in {(a, b) for x in by.values() for a in x for b in x if a < b}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k, percent, limit", [(3, 90, 20_000), (5, 80, 2)])
def test_jaccard_components(docs, texts, k, percent, limit):
    near = [(20_000 + i, " ".join(f"w{j if (j * 7 + i) % 40 else j + 1000 * i}" for j in range(120)), "en", "s") for i in range(12)]
    more = docs.sparkSession.createDataFrame([(d, t) for d, t, *_ in near], "doc_id long, text string")
    out = jaccard_join.jaccard_components(docs.select("doc_id", "text").union(more), k, percent, region_rows=limit)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == components([*texts, *near], k, percent)


def test_jaccard_edges(docs, spark):
    assert jaccard_join.jaccard_components(empty(docs)).count() == 0
    t = " ".join(f"a{i}" for i in range(30))
    rows = spark.createDataFrame([(None, t), (4, t), (4, t), (9, t)], "doc_id long, text string")
    assert sorted(map(repr, (tuple(r) for r in jaccard_join.jaccard_components(rows).collect()))) == sorted(map(repr, [(None, 26, None), (4, 26, 4), (4, 26, 4), (9, 26, 4)]))


def test_jaccard_null_id_before_a_known_copy(spark):
    t = " ".join(f"a{i}" for i in range(60))
    rows = spark.createDataFrame([(None, t), (4, t), (9, t + " end")], "doc_id long, text string").coalesce(1)
    assert sorted(map(repr, map(tuple, jaccard_join.jaccard_components(rows, 5, 80).collect()))) == sorted(map(repr, [(None, 56, None), (4, 56, 4), (9, 57, 4)]))


def test_region_solver_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = [rng.choice(400, 60, replace=False) for _ in range(6)]
        sets = []
        for _ in range(90):
            s = set(base[rng.integers(6)].tolist())
            for x in rng.choice(sorted(s), rng.integers(0, 7), replace=False):
                s.discard(int(x))
            sets.append(np.array(sorted(s | set(rng.integers(0, 400, rng.integers(0, 4)).tolist())), np.uint64))
        root = jaccard_join.Region(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 80).solve()
        want = components([(i, " ".join(map(str, s)), 0, 0) for i, s in enumerate(sets)], 1, 80)
        assert [int(x) for x in root] == [want[i][1] for i in range(len(sets))]


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    df = spark.createDataFrame(e, "a long, b long")
    one, many = ({tuple(r) for r in runtime.connected_components(df, n).collect()} for n in (10**6, 0))
    assert one == many and one


def test_meet_deals_large_keys(spark, monkeypatch):
    monkeypatch.setattr(runtime, "SHARES", 4)
    monkeypatch.setattr(runtime, "LEAST_PART", 3)
    rows = spark.createDataFrame([(0 if i % 3 else i % 7, i) for i in range(100)] + [(99, 5)], "k long, i long")
    points = spark.createDataFrame([(k, k * 10) for k in range(8)], "k long, v long")
    weights = runtime.cut(rows.join(points, "k").groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n"))
    got = runtime.meet(rows, points, ["k"], weights, "i")
    assert got.columns == ["k", "i", "v"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(points, "k").collect()))
    assert runtime.meet(rows.where("false"), points, ["k"], weights.where("false"), "i").count() == 0


def removed(texts, window=20):
    seen, out = {}, {}
    for d, t, *_ in sorted(texts, key=lambda x: x[0]):
        w = words(t)
        go = [0] * len(w)
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i : i + window]), (d, i)) != (d, i):
                go[i : i + window] = [1] * window
        out[d] = (len(w), sum(go), hashlib.sha256(b" ".join(x for x, g in zip(w, go, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs, texts, batches):
    out = substring_dedup.remove_repeats(docs, batches=batches)
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == removed(texts)
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0


@pytest.mark.parametrize("shares, least", [(runtime.SHARES, runtime.LEAST_PART), (5, 2)])
def test_line_dedup(docs, texts, monkeypatch, shares, least):
    monkeypatch.setattr(runtime, "SHARES", shares)
    monkeypatch.setattr(runtime, "LEAST_PART", least)
    docs = docs.selectExpr("*", "1 AS __gone", "2 AS __id", "3 AS __th", "4 AS __part")
    own, seqs, want = {}, {}, {}
    for d, t, *_ in sorted(texts, key=lambda x: x[0]):
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if x]
        seq = [lines[i] for i in at]
        anchor = [len(words(x)) >= line_dedup.MIN_WORDS for x in seq]
        gone = set()
        for p in {own[x] for x, a in zip(seq, anchor, strict=True) if a and x in own}:
            gone |= {at[j] for j in line_dedup.common_blocks(seqs[p], seq, anchor)}
        for x, a in zip(seq, anchor, strict=True):
            if a:
                own.setdefault(x, d)
        seqs[d] = seq
        want[d] = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == want
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


@pytest.mark.parametrize("shares, least", [(runtime.SHARES, runtime.LEAST_PART), (5, 2)])
def test_line_dedup_meets_every_partner(spark, docs, texts, monkeypatch, shares, least):
    monkeypatch.setattr(line_dedup, "RARE", 10**9)  # no run is common here: partners alone decide
    monkeypatch.setattr(runtime, "SHARES", shares)
    monkeypatch.setattr(runtime, "LEAST_PART", least)
    x, y, z = (f"line {c} of more than five words" for c in "xyz")
    own = lambda i: f"words that only document {i} has"
    # 50,002 and 50,003: crossing order, then a copy; 50,005 to 50,010: a line twice, alone in a shape, then aligned by a later one
    rows = [f"{x}\n{y}\n{z}", f"{z}\n{y}\n{x}", f"{z}\n{y}\n{x}", f"{x}\ns", f"{own(4)}\n{x}\n{own(40)}\n{x}\n{own(41)}", f"{own(5)}\n{x}\n{own(50)}\n{x}\n{own(51)}"]
    rows += [f"{x}\n{own(6)}\n{x}", f"{own(7)}\ns\n{y}\nt\n{own(70)}", f"{own(8)}\ns\n{y}\nt\n{own(80)}", f"{own(9)}\n{x}\n{own(90)}\n{x}\n{y}\n{own(91)}", f"{own(10)}\n{x}\n{own(92)}\n{x}\n{own(93)}\n{y}"]
    rng = np.random.default_rng(4)
    pool = [x, y, z, "s", "t", "", *(own(100 + i) for i in range(3))]
    rows += ["\n".join(pool[k] if k < len(pool) else own(1000 + 10 * i + j) for j, k in enumerate(rng.integers(0, len(pool) + 3, 6))) for i in range(60)]
    more = [(50_001 + i, t) for i, t in enumerate(rows)] + [(50_004, f"{x}\n{own(4)}"), (50_012, f"{z}\n{x}")]
    # 60,001 to 60,008: a whole copy of few words, a list of short lines, a line without spaces
    short, han = "a b\nc\nd e\nf", "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03\u516b\u4e5d\u5341"
    more += [(60_001, "hi\nho"), (60_002, "hi\nho"), (60_003, f"q\n{short}"), (60_004, f"{own(11)}\n{short}\nr"), (60_005, f"{han}\nu"), (60_006, f"v\n{han}"), (60_007, "c\nw"), (60_008, "c\nv")]
    every = sorted([*((d, t) for d, t, *_ in texts), *more], key=lambda r: r[0])
    want, seqs = [], []
    for d, t in every:
        lines = (t or "").split("\n")
        at = [i for i, v in enumerate(lines) if v]
        seq = [lines[i] for i in at]
        weight = [max(len(words(v)), len(re.findall("[\u3000-\u9fff\u0e00-\u0eff]", v)) // 2) for v in seq]
        gone = set()
        for e, other in seqs:
            if e < d and set(seq) & set(other):
                gone |= {at[j] for j in (range(len(seq)) if other == seq else line_dedup.heavy_blocks(other, seq, weight))}
        seqs.append((d, seq))
        want.append((d, None if t is None else "\n".join(v for i, v in enumerate(lines) if i not in gone)))
    out = line_dedup.dedup_lines(docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")), every=True)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    got = {d: v for d, v in want if d > 60_000}
    assert [got[60_000 + i] for i in (2, 4, 6, 8)] == ["", f"{own(11)}\nr", "v", "c\nv"]
    assert line_dedup.dedup_lines(empty(docs), every=True).count() == 0


def test_patience_keeps_order():
    assert line_dedup.patience([1, 2, 3, 4, 5], [9, 2, 3, 7, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert line_dedup.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)]) and line_dedup.patience([], [1]) == []


def test_chat_collapse(spark):
    t = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", None), (4, 0, "user", ""), (5, 0, "user", None), (6, 0, "user", ""), (None, 0, "user", "a")]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_collapse.render(df).collect()}
    assert got == {3: (3, 1), 4: (1, 2), 5: (1, 1)}
    assert chat_collapse.render(df).where("conv_id = 3").first().rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat_collapse.render(df.where("false")).count() == 0


def draw(doc, level, node, w):
    h = xxhash.xxh64_intdigest(f"{level} {node}".encode(), xxhash.xxh64_intdigest(struct.pack("<q", doc), 42))
    return -np.log(((h >> 11) + 0.5) / float(1 << 53)) / w


def descend(doc, n):
    tree = {}
    for s in hash_tree.layout(n):
        tree.setdefault(s.region, {}).setdefault(s.rack, []).append(s.number)
    region = min(tree, key=lambda r: draw(doc, "region", r, sum(map(len, tree[r].values()))))
    rack = min(tree[region], key=lambda k: draw(doc, "rack", k, len(tree[region][k])))
    return min(tree[region][rack], key=lambda s: draw(doc, "shard", s, 1))


def test_hash_tree(docs, texts):
    out = hash_tree.shard_documents(docs).collect()
    by = {d: (t or "").encode() for d, t, *_ in texts}
    assert len(out) == len(texts)
    for r in out:
        b = by[r.doc_id]
        assert (r.size, r.text_crc32, r.shard, r.grown_shard, r.law) == (len(b) + 1, zlib.crc32(b), descend(r.doc_id, 8), descend(r.doc_id, 9), "key")
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))
    assert hash_tree.shard_documents(empty(docs)).count() == 0


def test_hash_tree_moves_stay_in_changed_subtrees(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    heavy = tuple(hash_tree.Shard(s.region, s.rack, s.number, 3.0 if s.number == 1 else 1.0) for s in hash_tree.layout(8))
    moved = hash_tree.shard_documents(rows, hash_tree.layout(8), heavy).where("shard <> grown_shard").collect()
    assert moved and all(r.grown_shard < 4 for r in moved) and all(r.grown_shard in (0, 1) for r in moved if r.shard < 2)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.vocabulary_path())
    got = packing.pack_documents(docs).toPandas()
    want = {}
    for d, t, *_ in texts:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(-(-len(ids) // 2048)):
            own = ids[k * 2048 : (k + 1) * 2048]
            want[d, k] = (k * 2048, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.length.cumsum() - g.length == g.offset).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.1 + 1
    assert packing.pack_documents(empty(docs)).count() == 0


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(x) for x in (5, 6, 9, 4, 1)] == [(0, 0), (1, 0), (2, 0), (1, 6), (0, 5)]


def test_decontamination(spark, docs, texts, sf):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    items += [(900, None), (901, "..."), (902, "shared3 Shared4 shared5"), (903, texts[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pat = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pat.findall((t or "").encode().lower())
    keys = {}
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            keys.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = {}
    for d, t, *_ in texts:
        w, own = split(t), set()
        hit = [0] * len(w)
        for n in {len(k) for k in keys}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in keys:
                    own |= keys[x]
                    hit[i : i + n] = [1] * n
        s = sum(hit)
        want[d] = (len(w), s, len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), s > 0 and 20 * s >= len(w))
    for size in (decontaminate.BLOCK_BYTES, 2000):
        assert {r.doc_id: tuple(r)[1:6] for r in decontaminate.contamination(docs, bench, block_bytes=size).collect()} == want
        kept = decontaminate.keep_clean(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, x in want.items() if not x[4]}
    assert decontaminate.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(docs), bench).count() == 0


def test_url_reputation(spark):
    u = ["http://A.example.com/en/7x?q", "https://example.com/en/8", None, "nothing", "x://h.net/de/9#a/", "x://example.net/de/81", "x://evilexample.com/en/7", "http://bad.org/x", "http://BAD.org", "http://sub.bad.org/y"]
    pages = spark.createDataFrame(list(enumerate(u)), "page_id long, url string")
    bulk = spark.createDataFrame([(100 + i, f"http://{'bad' if i % 2 else 'good'}.org/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 0 if i % 2 else 1, 0) for i in range(400)] + [(100, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge_urls(pages.union(bulk), labels).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1] == ("example.com", "/en/8", "com/en/", "block")
    assert got[2][:3] == got[3][:3] == ("", "", None) and got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("example.net/de/8", "block")
    assert got[6][2] == "com/en/" and got[7][2:] == (None, "block") and got[8] == ("bad.org", "", None, "block") and got[100][3] == "allow"
    assert host_reputation.judge_urls(pages, labels.where("false")).where("rule IS NULL AND verdict = 'block'").count() == 0
    assert host_reputation.judge_urls(pages.where("false"), labels).count() == 0


def test_quality_rules(spark, docs, texts):
    rng = np.random.default_rng(3)
    plain = [(30_000 + i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(int(rng.lognormal(5, 0.7)) + 10)), "xx", "big") for i in range(300)]
    junk = [(31_000 + i, " ".join(f"a{j}### $${i}" for j in range(60)), "xx", "big") for i in range(60)]
    more = spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in robust_quality.quality_verdicts(docs.select(*more.columns).union(more)).collect()}
    for d, t, *_ in [*texts, *plain, *junk]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        rep = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed), d
        assert not (failed and r.kept)
    assert all(got[d].kept for d, *_ in plain) and not any(got[d].kept for d, *_ in junk)
    assert robust_quality.quality_verdicts(empty(docs)).count() == 0


def test_robust_distance_equals_numpy(spark):
    from pyspark.sql import functions as F

    a = np.random.default_rng(2).normal(size=(4, 4))
    c = a @ a.T + np.eye(4)
    cols = {(i, j): F.lit(float(c[i, j])) for i, j in robust_quality._PAIRS}
    inv = spark.range(1).select(*(v.alias(f"v{i}{j}") for (i, j), v in robust_quality._inverse(cols).items())).first()
    want = np.linalg.inv(c)
    assert all(abs(inv[f"v{i}{j}"] - want[i, j]) < 1e-9 for i, j in robust_quality._PAIRS)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, by = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = runtime.cut(stage(spark, docs, sf), "test")
        assert docs.columns == columns, name
        after = {r.doc_id for r in docs.collect()}
        assert after <= before and len(after) > 0.5 * len(before), name
        if name == "n-gram Jaccard join":
            comp = components([(r.doc_id, r.text) for r in prior.collect()], 5, 80)
            assert after == {d for d, (_, c) in comp.items() if c == d}
        prior = docs
    out = P.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(out.doc_id) == {r.doc_id for r in docs.collect()}
    whole = P.run(spark, sf).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[key].values.tolist())) == sorted(map(tuple, out[key].values.tolist())) and by


def test_registry_names():
    from tidewell.llm import registry

    q = registry.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in q if n != "pipeline"} == {str(i) for i in range(1, 11)} and json.dumps(sorted(q))


def test_finished_tables_relieve_the_driver(spark, monkeypatch):
    monkeypatch.setattr(runtime, "RELIEF_S", 0)
    monkeypatch.setattr(runtime, "_relieved", 0.0)
    assert runtime.cut(spark.range(3)).count() == 3 and runtime._relieved > 0
    at = runtime._relieved
    monkeypatch.setattr(runtime, "RELIEF_S", 3600)
    assert runtime.cut(spark.range(3)).count() == 3 and runtime._relieved == at
