"""Whole texts to token ids with a tokenizer file, a word at a time and each word once.

The vocabulary's pre-tokenizer never lets a token span ASCII white space, so a text's ids are its words' ids in
order. Words are told apart by 64-bit hashes on whole Arrow buffers; only words that this worker hasn't seen go to
the tokenizers library. The table of known words is emptied at MAX_WORDS, so its memory is bounded.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np

from . import kernels as K

MAX_WORDS = 3_000_000
_PLAIN = r"[!-~¡-ÿ]+"
_tables: dict[str, "TokenTable"] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(path: str) -> "TokenTable":
    """This worker's table for a vocabulary file."""
    if path not in _tables:
        _tables[path] = TokenTable(path)
    return _tables[path]


class TokenTable:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.plain = regex.compile(_PLAIN)
        self.pieces = self.bare = None
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = spec["model"].get("end_of_word_suffix")
        if len(steps) == 2 and steps[0]["type"] == "Split" and steps[1]["type"] == "ByteLevel" and suffix:
            # the same model on pieces that are already split and lower-cased: they come back with their ends marked
            self.pieces = regex.compile(steps[0]["pattern"]["Regex"])
            spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
            self.bare = Tokenizer.from_str(json.dumps(spec))
            self.ends = np.zeros(self.whole.get_vocab_size() + 1, bool)
            for token, i in self.whole.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
        self.reset()

    def reset(self) -> None:
        self.known, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids of each word)."""
        out: list = [None] * len(words)
        plain = []
        for i, w in enumerate(words):
            if self.bare is not None and self.plain.fullmatch(w) and not any(s in w for s in self.special):
                plain.append(i)
            else:
                out[i] = self.whole.encode(w, add_special_tokens=False).ids
        if plain:
            parts = [self.pieces.findall(words[i].lower()) for i in plain]
            known: dict[str, int] = {}
            for p in parts:
                for x in p:
                    known.setdefault(x, len(known))
            names = list(known)
            text = [" ".join(names[i : i + 256]) for i in range(0, len(names), 256)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(text, add_special_tokens=False)]) if text else np.zeros(0, np.uint32)
            cut = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cut) != len(names) + 1:
                raise ValueError("the vocabulary doesn't mark the ends of words")
            ids = ids.tolist()
            each = [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            for i, p in zip(plain, parts, strict=True):
                out[i] = each[known[p[0]]] if len(p) == 1 else [y for x in p for y in each[known[x]]]
        n = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((y for x in out for y in x), np.uint32, int(n.sum())), n

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each text) of one slice."""
        w = K.Words(buf, offs, K.WHITE, False)
        u, at, inverse = np.unique(w.h, return_index=True, return_inverse=True)
        if len(self.known) > MAX_WORDS:
            self.reset()
        place = np.searchsorted(self.known, u)
        new = np.ones(len(u), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != u[inside]
        if new.any():
            raw = buf.tobytes()
            ids, n = self.words([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[at[new]], w.ends[at[new]], strict=True)])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), self.used), np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            first = self.used + np.cumsum(n) - n
            self.used += len(ids)
            self.start = np.insert(self.start, place[new], first)
            self.count = np.insert(self.count, place[new], n)
            self.known = np.insert(self.known, place[new], u[new])
            place = np.searchsorted(self.known, u)
        start, n = self.start[place][inverse], self.count[place][inverse]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        ids = self.pool[np.repeat(start - (end - n), n) + np.arange(total)]
        per = np.concatenate([[0], end])[w.first]
        return ids, np.diff(per)


def with_end(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by end_id; (ids, offsets)."""
    offs = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(offs[-1], end_id, np.uint32)
    keep = np.ones(offs[-1], bool)
    keep[offs[1:] - 1] = False
    out[keep] = ids
    return out, offs


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
