"""Language identification with a linear-chain conditional random field.

Words (a letter, then letters and marks) are labelled one by one, so code-switched text gets a
language per word.  A word's features are hashed: its prefixes and suffixes of
1 to 3 characters, its character pairs and triples and the word itself (the
learned lexicon).  Transition weights between the labels of neighbouring words
are learned with them, by stochastic gradient on the conditional likelihood;
forward-backward gives the gradients and, at prediction, each word's
posterior.  A text's language is the label of the largest mean posterior over
all its words, which is also its score.

Training reads only text and lang of documents outside the held-out fold, a
sample bounded by about ``TRAIN_DOCS`` different rows per language (chosen by a hash of
their id and text, the first of that order and twice as many at most; of a longer text
a window of ``TRAIN_CHARS`` characters, placed by that hash and cut on the executors),
cut into stretches that are strung together across languages, so that the chain sees
switches; training takes ``CHAIN`` words at a time as one sequence.
Every language of those documents is learned, however rare: the model is ``DIM``
weights per language (262 MB for 1000 languages; driver and workers hold it whole, the
driver while training three times and with the sample).  Prediction reads whole texts,
and a text is one chain however long: its stretches of ``CHAIN`` words are worked on side
by side, each starts from its neighbours' messages, and those whose messages still
change are worked on again, until none does (``SETTLED``).  So ``CHAIN`` is a size of
work and not a border: after n rounds the first and last n stretches are exact, and as a
chain forgets its start soon, two or three rounds settle texts of any length.

A null text, or one without a letter, is ``und`` with score 0; so is every
text when no labelled row is there to learn from.  Ties go to the label that
sorts first.  Every row gives one row; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FOLDS = 5
TRAIN_DOCS = 150           # per language
TRAIN_WORDS = 150          # longest stretch taken from a training text at a time
TRAIN_CHARS = 20_000       # longest window taken from a training text
DIM = 1 << 15
CHAIN = 64                 # words worked on as one row of arrays
SETTLED = 1e-12            # largest change of a message that counts as none
EPOCHS, RATE = 3, 0.2
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def _room(n: int, labels: int) -> int:
    """``n`` for few labels, and less for many: work arrays keep their size."""
    return max(1, n * 8 // max(8, labels))


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(40)) % np.uint64(DIM)).astype(np.int64)


class Words:
    """Distinct words with their hashed features in flat arrays: all pairs and
    triples of the word between two border marks (those at the borders are the
    affixes of one and two characters), the affixes of three, and the word."""

    def __init__(self, distinct):
        marked = [f"^{w.lower()}$" for w in distinct]
        size = np.array([len(w) for w in marked], np.int64)
        c = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(marked)), size)
        first = np.cumsum(size) - size
        found, owner = [], []
        with np.errstate(over="ignore"):
            radix = np.uint64(0x100000001B3)
            for n in (2, 3, 4):
                at = np.arange(max(len(c) - n + 1, 0))
                at = at[word[at] == word[at + n - 1]]
                if n == 4:                              # affixes of three characters
                    for kind, ends in ((4, first), (5, first + size - 4)):
                        own = ends[size >= 4]
                        found.append(_bucket(sum(c[own + i] * radix ** np.uint64(i) for i in range(4)), kind))
                        owner.append(np.flatnonzero(size >= 4))
                else:
                    found.append(_bucket(sum(c[at + i] * radix ** np.uint64(i) for i in range(n)), n))
                    owner.append(word[at])
            if len(c):
                power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), radix, np.uint64)])
                whole = np.add.reduceat(c * power[np.arange(len(c)) - first[word]], first)
                found.append(_bucket(whole, 1))
                owner.append(np.arange(len(marked)))
        own = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(own, kind="stable")
        self.feature = np.concatenate(found)[order] if found else own
        self.size = np.bincount(own, minlength=len(marked))
        self.start = np.cumsum(self.size) - self.size

    def emissions(self, weight: np.ndarray) -> np.ndarray:
        if not len(self.size):
            return np.zeros((0, weight.shape[1]))
        return np.add.reduceat(weight[self.feature], self.start, axis=0) / self.size[:, None]


class Emitter:
    """Emission scores of words under one model, kept in a bounded cache."""

    BOUND = 150_000

    def __init__(self, weight: np.ndarray):
        self.weight, self.place, self.rows = weight, {}, np.zeros((0, weight.shape[1]))

    def __call__(self, distinct) -> np.ndarray:
        if len(self.place) > _room(self.BOUND, self.weight.shape[1]):
            self.place, self.rows = {}, self.rows[:0]
        new = [w for w in distinct if w not in self.place]
        self.place.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, Words(new).emissions(self.weight)])
        return self.rows[[self.place[w] for w in distinct]]


_WORKER: list[Emitter] = []


def _emitter(weight: np.ndarray) -> Emitter:
    if not _WORKER or _WORKER[0].weight is not weight:
        _WORKER[:] = [Emitter(weight)]
    return _WORKER[0]


def forward_backward(emit: np.ndarray, move: np.ndarray, real: np.ndarray):
    """Posteriors of the labels (chain, place, label) of many chains at once,
    the sum of their expected transitions, and which places have a word
    followed by one; ``real`` marks the places that hold a word."""
    n, t, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    m = np.exp(move - move.max())
    alpha, beta = np.empty((n, t, k)), np.ones((n, t, k))
    a = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    alpha[:, 0] = a
    for i in range(1, t):
        step = (a @ m) * e[:, i]
        step /= step.sum(axis=1, keepdims=True)
        a = np.where(real[:, i, None], step, a)
        alpha[:, i] = a
    for i in range(t - 2, -1, -1):
        step = (e[:, i + 1] * beta[:, i + 1]) @ m.T
        step /= step.sum(axis=1, keepdims=True)
        beta[:, i] = np.where(real[:, i + 1, None], step, 1.0)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    both, before, ahead = real[:, 1:], alpha[:, :-1], (e * beta)[:, 1:]
    share = both / ((before @ m) * ahead).sum(axis=2)
    expected = m * np.tensordot(before * share[..., None], ahead, axes=([0, 1], [0, 1]))
    return post, expected, both


def stretches(code: np.ndarray, doc: np.ndarray, length: int):
    """Cut flat words into stretches inside their documents: positions
    (stretch, place) with -1 where a document has ended."""
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    fresh = place % length == 0
    chain = np.cumsum(fresh) - 1
    at = np.full((int(chain[-1]) + 1 if len(chain) else 0, length), -1, np.int64)
    at[chain, place % length] = np.arange(len(code))
    return at


def train(rows: list[tuple[str, str]], labels: list[str], seed: int = 7):
    """Feature and transition weights from (text, lang) rows."""
    rng = np.random.default_rng(seed)
    k = len(labels)
    weight, move = np.zeros((DIM, k)), np.zeros((k, k))
    pieces, number = [], {lang: i for i, lang in enumerate(labels)}
    for text, lang in rows:
        words = WORD.findall(text)
        pieces += [(words[i:i + TRAIN_WORDS], number[lang]) for i in range(0, len(words), TRAIN_WORDS)]
    if not pieces:
        return weight, move
    order = rng.permutation(len(pieces))
    flat = [w for s in order for w in pieces[s][0]]
    gold = np.array([y for s in order for y in [pieces[s][1]] * len(pieces[s][0])])
    code, distinct = pd.factorize(np.array(flat, object))
    words = Words(distinct)
    at = stretches(code, np.zeros(len(code), np.int64), CHAIN)     # pieces follow one another: switches inside chains
    sum_w, sum_m = np.full_like(weight, 1e-6), np.full_like(move, 1e-6)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(at)), max(1, len(at) // 64)):
            idx = at[part]
            real = idx >= 0
            here = code[np.maximum(idx, 0)]
            used, local = np.unique(here, return_inverse=True)
            feats = np.concatenate([words.feature[words.start[u]:words.start[u] + words.size[u]] for u in used])
            owner = np.repeat(np.arange(len(used)), words.size[used])
            score = np.zeros((len(used), k))
            np.add.at(score, owner, weight[feats])
            emit = (score / words.size[used][:, None])[local.reshape(here.shape)]
            post, expected, both = forward_backward(emit * 4, move, real)
            y = gold[np.maximum(idx, 0)]
            error = -post * real[..., None]
            error[np.arange(len(idx))[:, None], np.arange(idx.shape[1])[None, :], y] += real
            per_word = np.zeros((len(used), k))
            np.add.at(per_word, local.reshape(-1), error.reshape(-1, k))
            grad = np.zeros_like(weight)
            np.add.at(grad, feats, (per_word / words.size[used][:, None])[owner])
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
            change = seen - expected
            sum_w += grad ** 2
            sum_m += change ** 2
            weight += RATE * 4 * grad / np.sqrt(sum_w)
            move += RATE * change / np.sqrt(sum_m)
    return weight * 4, move


def training_rows(docs: DataFrame) -> tuple[list[tuple[str, str]], list[str]]:
    """A bounded sample of labelled rows outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # copies count once, wherever their ids are the same
    h = F.xxhash64("doc_id", "text")
    counted = rows.select("lang", h.alias("h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not counted:
        return [], []
    labels = [r["lang"] for r in counted]
    shares = docs.sparkSession.createDataFrame([(r["lang"], TRAIN_DOCS / r["n"]) for r in counted], "lang string, share double")
    drawn = (rows.join(F.broadcast(shares), "lang").where(F.pmod(h, F.lit(1 << 30)) / (1 << 30) < F.col("share"))
             .groupBy("lang", "text").agg(F.min(h).alias("h")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = drawn.withColumn("first", first).where(F.col("first") <= 2 * TRAIN_DOCS)
    past = F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0))
    window = F.substring(F.col("text"), (F.pmod("h", past + 1) + 1).cast("int"), F.lit(TRAIN_CHARS))
    return sorted((r["text"], r["lang"]) for r in chosen.select(window.alias("text"), "lang").collect()), sorted(labels)


def held_out():
    """crc32 of the id as text falls in the fold that is kept for testing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def label_words(texts: list[str], model, labels: list[str],
                length: int = CHAIN) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Posterior (word, label) of all words of several texts, the words'
    documents, and the words.  ``length`` words of a text are worked on as one
    row; it does not change the posteriors."""
    weight, move = model
    split = [WORD.findall(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
    flat = np.empty(len(doc), object)
    flat[:] = [w for ws in split for w in ws]
    code, distinct = pd.factorize(flat)
    at = stretches(code, doc, length)
    out = np.zeros((len(code), len(labels)))
    if not len(code):
        return out, doc, split
    emit = _emitter(weight)(distinct)
    owner = doc[at[:, 0]]
    tied = np.flatnonzero(owner[1:] == owner[:-1])       # stretches that the next one goes on
    before, after = (np.full((len(at), len(labels)), 1 / len(labels)) for _ in range(2))
    onward, backward = np.empty_like(before), np.empty_like(before)
    todo = np.arange(len(at))
    while len(todo):
        for part in np.array_split(todo, -(-len(todo) // _room(2048, len(labels)))):
            real = at[part] >= 0
            post, onward[part], backward[part] = posterior(
                emit[code[np.maximum(at[part], 0)]], move, real, before[part], after[part])
            out[at[part][real]] = post[real]
        change = np.zeros(len(at))
        change[tied + 1] = np.abs(onward[tied] - before[tied + 1]).max(axis=1)
        change[tied] = np.maximum(change[tied], np.abs(backward[tied + 1] - after[tied]).max(axis=1))
        before[tied + 1], after[tied] = onward[tied], backward[tied + 1]
        todo = np.flatnonzero(change > SETTLED)
    return out, doc, split


def posterior(emit: np.ndarray, move: np.ndarray, real: np.ndarray, before: np.ndarray, after: np.ndarray):
    """Posteriors of stretches (stretch, place, label), given the messages
    ``before`` their first and ``after`` their last word (even ones where a
    text begins or ends), and the messages that they send on and back."""
    n, t, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    m = np.exp(move - move.max())
    alpha, beta = np.empty((t, n, k)), np.empty((t, n, k))
    e = np.ascontiguousarray(e.transpose(1, 0, 2))
    live = real.T[:, :, None]
    a = before * e[0]
    a /= a.sum(axis=1, keepdims=True)
    alpha[0] = a
    for i in range(1, t):
        step = (a @ m) * e[i]
        step /= step.sum(axis=1, keepdims=True)
        a = np.where(live[i], step, a)
        alpha[i] = a
    beta[-1] = after
    for i in range(t - 2, -1, -1):
        step = (e[i + 1] * beta[i + 1]) @ m.T
        step /= step.sum(axis=1, keepdims=True)
        beta[i] = np.where(live[i + 1], step, after)
    onward, backward = a @ m, (e[0] * beta[0]) @ m.T
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    return (post.transpose(1, 0, 2), onward / onward.sum(axis=1, keepdims=True),
            backward / backward.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, model, labels: list[str], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)      # DIM * labels numbers
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    names = np.array([*labels, "und"], object)

    def run(batches):
        for batch in batches:
            for start, texts in common.text_blocks(batch, max_chars=_room(1 << 20, len(labels))):
                best, score = np.full(len(texts), len(labels)), np.zeros(len(texts))
                if labels:
                    post, doc, split = label_words(texts, shipped.value, labels)
                    n = np.array([len(ws) for ws in split])
                    total = np.stack([np.bincount(doc, post[:, i], minlength=len(texts)) for i in range(len(labels))], axis=1)
                    mean = total / np.maximum(n, 1)[:, None]
                    best = np.where(n > 0, mean.argmax(axis=1), len(labels))
                    score = np.where(n > 0, np.clip(mean.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(start, len(texts)) for i in range(len(keep))),
                     pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                    names=[*(f"_{i}" for i in range(len(keep))), "lang_pred", "score"])

    kinds = [f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = rows.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double"]))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def op2_crf_langid(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows, labels = training_rows(docs)
    found = predict(docs.select("doc_id", "text"), train(rows, labels), labels, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
