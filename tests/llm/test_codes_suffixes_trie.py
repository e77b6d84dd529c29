"""Resident Lloyd, suffix-array dedup and the prefix trie against plain
versions."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradeframe.llm import common, prefix_trie, resident_lloyd, suffix_dedup

SF = "/root/testdata/sf0.001"


# -- resident Lloyd ---------------------------------------------------------

def plain_codes(rows):
    rows = [r for r in rows if r[1] and len(r[1]) % 16 == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    w = len(rows[0][1]) // 16
    cut = [[tuple(math.floor(256 * x) for x in v[p * w:p * w + w]) for p in range(16)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:64]] for p in range(16)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(2):
        for p in range(16):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(own[e]) for x in zip(*own[e])) if own[e] else entry
                        for e, entry in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    found, label = [], Counter()
    for (i, _, lab), c in zip(rows, cut):
        best = [near(c[p], books[p]) for p in range(16)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), lab))
        label[lab] += found[-1][2]
    return sorted(((i, code, err, label[lab], sha) for i, code, err, lab in found), key=str)


def codes(monkeypatch, df):
    monkeypatch.setattr(common, "read", lambda *a: df)
    got = resident_lloyd.op11_resident_lloyd(df.sparkSession, "").select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


def as_rows(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]


def test_lloyd_equals_plain_version(spark, monkeypatch):
    common.read(spark, SF, "embeddings")
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)], rng.choice([1, 2, None]), "x") for i in range(150)]
    rows += [(7, rows[7][1], 1, ""), (7, rows[9][1], 2, ""), (None, rows[1][1], 2, ""), (500, None, 1, "")]
    rows += [(501 + i, [bad] * 32, 1, "") for i, bad in enumerate([None, float("nan"), float("inf"), float("-inf")])]
    rows += [(510, [1.0] * 16, 3, ""), (511, [], 3, ""), (512, [1.0] * 5, 2, "")]
    rows += [(600 + i, [0.5] * 32, 9, "") for i in range(200)]              # a hot vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")
    assert codes(monkeypatch, df) == plain_codes(as_rows(df))
    for n in (0, 1, 30):
        few = df.limit(n).cache()
        assert codes(monkeypatch, few) == plain_codes(as_rows(few))


def test_lloyd_on_given_table_and_many_owners(spark, monkeypatch):
    df = common.read(spark, SF, "embeddings")
    want = plain_codes(as_rows(df))
    monkeypatch.setattr(resident_lloyd, "OWNED", 50)
    assert codes(monkeypatch, df) == want


def test_lloyd_only_changed_parts_pass_the_shuffle(spark, monkeypatch):
    df = common.read(spark, SF, "embeddings")
    dealt = []
    kept = resident_lloyd._judge

    def judge(residents, books):
        out = common.checkpoint(kept(residents, books))
        dealt.append((out.count(), out.where("now <> entry").count()))
        return out

    monkeypatch.setattr(resident_lloyd, "_judge", judge)
    resident_lloyd.compress(df).count()
    (parts, changed), (after, _) = dealt
    assert parts == after == 16 * df.count() and 0 < changed < parts / 2


def test_lloyd_extreme_components_do_not_overflow(spark, monkeypatch):
    rows = [(0, [3e38] * 64, 1), (1, [-3e38] * 64, 1), (2, [0.0] * 64, 1)] + [(i, [-3e38] * 63 + [1.0], 1) for i in range(3, 90)]
    got = codes(monkeypatch, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert len(got) == 90 and all(e >= 0 and t >= e for _, _, e, t, _ in got)


# -- suffix arrays ----------------------------------------------------------

def plain_dedup(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                hit[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if hit[i] and not (i and hit[i - 1]))
        out.append((len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    return out


def dedup(df, **how):
    got = suffix_dedup.deduplicate(df, ["doc_id"], **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return {r[0]: tuple(r[1:]) for r in got.collect()}


def test_suffix_order_equals_sorting():
    rng = random.Random(1)
    for _ in range(3000):
        text = bytes(rng.choice(b"abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 40)))
        assert suffix_dedup.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])
    for text in (b"a" * 5000, b"ab" * 2500, bytes(range(256)) * 8, bytes(range(255, -1, -1)) * 8):
        assert suffix_dedup.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_lyndon_groups_share_their_longest_lyndon_prefix():
    rng = random.Random(2)
    for _ in range(500):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 25)))
        ends = [next((j for j in range(i + 1, len(text)) if text[j:] < text[i:]), len(text)) for i in range(len(text))]
        want = sorted({text[i:ends[i]] for i in range(len(text))})
        groups, smaller = suffix_dedup.lyndon_groups(text)
        assert [{text[i:ends[i]] for i in g} for g in groups] == [{w} for w in want]
        for i, p in enumerate(smaller):
            assert p == max((j for j in range(i) if text[j:ends[j]] < text[i:ends[i]]), default=-1)


@pytest.mark.parametrize("most", [1 << 18, 60])          # 60 bytes: nearly all groups go down the ladder
def test_dedup_equals_plain_version(spark, most):
    common.read(spark, SF, "documents")
    rng = random.Random(most)
    base = "".join(rng.choice("abé") for _ in range(300))
    texts = [None, "", "a" * 50, "a" * 5000, "ab" * 40, "x" * 7, "x" * 8, "yyyyyyyy"]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for i in range(40):
        at = rng.randint(0, 250)
        texts.append(base[at:at + rng.randint(5, 50)] + str(i))
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes long")
    got, want = dedup(df, length=8, most=most), plain_dedup(texts, 8)
    assert [got[i] for i in range(len(texts))] == want
    assert dedup(df.limit(0), length=8) == {}


def test_dedup_of_repeated_rows_and_a_hot_passage(spark):
    """A passage of just the length in many different texts, and copies."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(20))
    texts = [f"{i:06d}{passage}{i * 7919 % 999983:06d}" for i in range(300)] + ["one copy of many, long enough"] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, want = dedup(df, length=20, most=500), plain_dedup(texts, 20)
    assert [got[i] for i in range(len(texts))] == want
    assert got[0][1] >= 20 and got[320][1] == len(texts[320])


@pytest.mark.parametrize("most", [1 << 18, 400])
def test_periodic_passages_of_any_phase(spark, most):
    rng = random.Random(most)
    texts = [f"{i:04d}" + ("abcde" * 40)[rng.randint(0, 4):rng.randint(60, 200)] + f"{i * 7919 % 9973:04d}" for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = dedup(df, length=20, most=most), plain_dedup(texts, 20)
    assert [got[i] for i in range(len(texts))] == want


def test_equal_runs_of_a_text_are_one_row(spark):
    common.read(spark, SF, "documents")
    text = "abcde" * 100
    df = spark.createDataFrame([(1, 2, 1, bytearray(text.encode()))], "s1 long, s2 long, weight long, text binary")
    rows = suffix_dedup._anchor_rows(df, 40, 40).collect()
    assert len(rows) == 5                                # 461 windows, five different ones
    assert sorted(i for r in rows for i in [r["first"], *r["again"]]) == list(range(461))
    assert sum(r["weight"] for r in rows) == 461


def test_regions_are_cut_to_what_they_share(spark, monkeypatch):
    rng = random.Random(7)
    for _ in range(300):
        regions = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) + "#" for _ in range(rng.randint(1, 5))]
        at = [len(r) - 1 for r in regions]
        regions = [(r + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))).encode() for r in regions]
        want = []
        for i, (r, p) in enumerate(zip(regions, at)):
            others = [(o, q) for j, (o, q) in enumerate(zip(regions, at)) if j != i]
            left = max((len(os.path.commonprefix([r[:p][::-1], o[:q][::-1]])) for o, q in others), default=0)
            right = max((len(os.path.commonprefix([r[p:], o[q:]])) for o, q in others), default=0)
            want.append((p - left, p + right))
        assert suffix_dedup.shared_extents(regions, at) == want
    # two regions that share a string, but not a window, are not sorted
    sorted_bytes = []
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda bodies, *_: sorted_bytes.append(bodies) or [[] for _ in bodies])
    monkeypatch.setattr(suffix_dedup.common, "lean", lambda f: f)
    h = int(suffix_dedup.string_hashes(_bytes("#12345#"), 7, *suffix_dedup.powers(50)).view("int64")[0])
    group = [(h, 1, 1, 1, b"a" * 20 + b"#12345#" + b"c" * 20), (h, 2, 2, 1, b"b" * 20 + b"#12345#" + b"c" * 20),
             (h, 3, 3, 1, b"b" * 20 + b"#12345#" + b"d" * 20)]
    run = {}

    class Regions:
        def __getattr__(self, _):
            return lambda *a, **k: self

        def mapInArrow(self, f, _):
            run["f"] = f

    import pyarrow as pa
    suffix_dedup._sort_groups(Regions(), 40, 7)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*group)], names=["h", "r1", "r2", "weight", "region"])
    assert list(run["f"](iter([batch]))) == [] and sorted_bytes == []


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    rng = random.Random(6)
    half = "".join(rng.choice("abcd") for _ in range(500))
    texts = [half + "".join(rng.choice("abcd") for _ in range(500)), "".join(rng.choice("abcd") for _ in range(37)) + half]
    power, inverse = suffix_dedup.powers(200)
    runs = [r for t in texts for found in suffix_dedup.anchors(_bytes(t), 6, 40, power, inverse, 4096, 64) for r in zip(*found)]
    assert len(runs) > 20
    whole = [sum(z - a + 1 for _, a, z, _ in runs)]
    assert whole == [sum(len(t) - 39 for t in texts)]               # every window has one name
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dedup(df, length=40)
    assert [got[0], got[1]] == plain_dedup(texts, 40)


def _bytes(text):
    import numpy as np
    return np.frombuffer(text.encode(), np.uint8)


def test_dedup_on_given_documents(spark):
    df = common.read(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.op12_suffix_dedup(spark, SF).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == dict(zip([i for i, _ in rows], plain_dedup([t for _, t in rows], 400)))


# -- prefix trie ------------------------------------------------------------

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    nodes, below = defaultdict(list), defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    for n in nodes:
        if n:
            below[n[:-1]].append(n)
    leaves, saved, out = {}, {}, []
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in below[n]) or 1
        saved[n] = sum(saved[k] for k in below[n]) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
        ends = sorted(c for c in nodes[n] if len(rebuilt[c]) == len(n))
        out.append((min(nodes[n]), len(n), min(nodes[n[:-1]]) if n else None, len(nodes[n]), len(below[n]), leaves[n],
                    saved[n], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).select(*TRIE).collect()), key=str)


def some_conversations(seed):
    rng = random.Random(seed)
    ids = [None, -250, -200, -7, 0, 100, 1200, *rng.sample(range(1300), 260)]
    return [(c, rng.choice([t, t, t, None]), rng.choice(["u", None]), rng.choice(["a", "bé", "", None] if t < 4 else ["a", "x"]))
            for c in ids for t in range(rng.choice([1, 2, 3, 7, 9]))]


@pytest.mark.parametrize("seed", [5, 6])
def test_trie_equals_plain_version(spark, seed):
    common.read(spark, SF, "conversations")
    rows = some_conversations(seed)
    if seed == 6:                                   # two long equal ones, repeated rows
        rows += [(c, t, "u", f"long {t % 3}") for c in (5000, 5001) for t in range(700)] + rows[:5]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth long")
    assert trie(df) == plain_trie(rows)
    assert trie(df.limit(0)) == []


def test_trie_without_any_turn_left(spark):
    rows = [(101 + i, 0, "u", "x") for i in range(3)]           # no base; those with h > 0 lose their turn
    assert trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == plain_trie(rows)


def test_trie_hot_first_turn_and_ends_of_many_blocks(spark):
    rows = [(1000 * i + j, t, "u", f"turn {t}") for i in range(30) for j in range(0, 40) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie(df) == plain_trie(rows)


def test_trie_starts_again_when_fingerprints_collide(spark, monkeypatch):
    rows = some_conversations(8)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept, seeds = prefix_trie.prefix_products, []

    def products(turns, seed):
        seeds.append(seed)
        same = turns.withColumn("text", F.lit("same")).withColumn("role", F.lit("")) if seed == 0 else turns
        return kept(same, seed)

    monkeypatch.setattr(prefix_trie, "prefix_products", products)
    assert trie(df) == plain_trie(rows)
    assert seeds == [0, 1]


def test_trie_on_given_conversations(spark):
    df = common.read(spark, SF, "conversations")
    assert trie(df) == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
