"""BPE encoding and decoding in batched numpy merge rounds.

Pre-tokens that a worker has not seen yet are encoded together: all their
symbols lie in one flat array.  Each round finds every neighbouring pair's
rank by binary search over the sorted pair keys, takes each word's lowest
rank, and merges that pair wherever it stands in the word, left to right and
without overlap.  (A pair whose product could at once take part in an earlier
merge is merged at its first place only; the order of merges is then the same
as one at a time.)  Words without a rankable pair leave the array.

Encoded pre-tokens are kept in a bounded cache per worker.

A null text counts as empty and has no tokens; every row gives one row.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MODEL = "word_bpe_49k.json"
CACHE_BOUND = 100_000
CACHE_CHARS = 1 << 23      # characters of its words, ids and decoded texts

# Fixed values of the tokenizer's format.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN = "ß-öø-ɏ"   # lower-case range of the plain case: all letters
PLAIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ]")
WORDS_PLAIN = re.compile(f"{CONTRACTIONS}|[a-z{LATIN}]+|[0-9]|[^{SPACE}a-z0-9{LATIN}]+")
WORDS_ANY = regex.compile(f"{CONTRACTIONS}|\\p{{L}}+|\\p{{N}}|[^{SPACE}\\p{{L}}\\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Symbol ids, sorted pair keys and ranks of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        end = model["end_of_word_suffix"]
        self.inner = np.array([ids[c] for c in byte_symbols()], np.int64)
        self.last = np.array([ids[c + end] for c in byte_symbols()], np.int64)
        self.base = max(ids.values()) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([ids[x] for x in xs], np.int64)
                             for xs in zip(*((a, b, a + b) for a, b in merges)))
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # the earliest merge that uses a symbol; a product used earlier than it is made needs care
        first_use = np.full(self.base, len(merges), np.int64)
        np.minimum.at(first_use, left, np.arange(len(merges)))
        np.minimum.at(first_use, right, np.arange(len(merges)))
        self.careful = first_use[made] < np.arange(len(merges))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word (no word is empty)."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(b) for b in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), sizes)
        ends = np.cumsum(sizes) - 1
        sym = self.inner[data]
        sym[ends] = self.last[data[ends]]
        none = len(self.ranks)
        done_sym, done_word = [], []
        while len(sym):
            same = np.zeros(len(sym), bool)      # has a right neighbour in its word
            same[:-1] = word[:-1] == word[1:]
            key = np.zeros(len(sym), np.int64)
            key[:-1] = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            spans = np.diff(np.r_[starts, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, starts), spans)
            over = best == none
            done_sym.append(sym[over])
            done_word.append(word[over])
            hit = np.flatnonzero((rank == best) & ~over)
            if not len(hit):
                break
            # runs of overlapping places (a a a): every second one; a careful pair: its first place
            fresh = np.r_[True, (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - run) % 2 == 0
            new_word = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            take &= new_word | ~self.careful[rank[hit]]
            hit = hit[take]
            sym = sym.copy()
            sym[hit] = self.made[rank[hit]]
            stay = ~over
            stay[hit + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        cuts = np.cumsum(np.bincount(word, minlength=len(raw)))[:-1]
        return [part.tolist() for part in np.split(sym[order], cuts)]

    def pre_tokens(self, text: str) -> list[str]:
        """Words of a text without special strings, in the tokenizer's normal form."""
        if not PLAIN.search(text):
            return WORDS_PLAIN.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return WORDS_ANY.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special strings in order."""
        if "<|" not in text:
            return self.pre_tokens(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.pre_tokens(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The symbols' texts, joined by one space as the tokenizer has no decoder."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """A vocabulary with a bounded cache of encoded pre-tokens."""

    def __init__(self, path: str, bound: int = CACHE_BOUND):
        self.voc, self.bound, self.cache = vocabulary(path), bound, {}
        self._reset()

    def _reset(self):
        self.cache.clear()
        self.chars = 0
        for content, i in self.voc.special.items():
            self.cache[content] = (1, str(i), content)

    def learn(self, split: list[list[str]]) -> None:
        if len(self.cache) > self.bound or self.chars > CACHE_CHARS:
            self._reset()
        words = sorted({w for ws in split for w in ws} - self.cache.keys())
        for w, ids in zip(words, self.voc.encode_words(words) if words else ()):
            entry = self.cache[w] = (len(ids), " ".join(map(str, ids)), self.voc.decode(ids))
            self.chars += len(w) + len(entry[1]) + len(entry[2])

    def batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: token count, its ids and its decoded text."""
        split = [self.voc.pieces(t) for t in texts]
        self.learn(split)
        get, out = self.cache.__getitem__, []
        for ws in split:
            n, ids, decoded = zip(*map(get, ws)) if ws else ((), (), ())
            out.append((sum(n), " ".join(ids), " ".join(decoded)))
        return out


_WORKER: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def _digest(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def encode_documents(docs: DataFrame, path: str, keep: list[str], text: str = "text", digests: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids (decimal, one space between) and the
    decoded text of every row; with ``digests`` the sha256 of both instead."""
    names = ["n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        enc = _encoder(path)
        for batch in batches:
            for start, texts in common.text_blocks(batch, "_text"):
                got = enc.batch(texts)
                put = _digest if digests else str
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, len(texts)) for c in keep),
                     pa.array([g[0] for g in got], pa.int64()),
                     pa.array([put(g[1]) for g in got], pa.string()), pa.array([put(g[2]) for g in got], pa.string())],
                    names=[*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields),
                        f"{names[0]} long", f"{names[1]} string", f"{names[2]} string"])
    return rows.mapInArrow(common.lean(run), schema)


def op9_batched_bpe(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return encode_documents(docs, common.tokenizer_path(MODEL), ["doc_id"], digests=True)
