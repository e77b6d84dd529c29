"""Text metrics (X16-X19, B1-B5, B10) against the published doctest values
and worked cases."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeframe.functions import text as X
from gradeframe.operators import bleu as B

H1 = "It is a guide to action which ensures that the military always obeys the commands of the party"
H2 = "It is to insure the troops forever hearing the activity guidebook that party direct"
R1 = "It is a guide to action that ensures that the military will forever heed Party commands"
R2 = "It is the guiding principle which guarantees the military forces always being under the command of the Party"
R3 = "It is the practical guide for the army always to heed the directions of the party"
H2B = "he read the book because he was interested in world history"
R2A = "he was interested in world history because he read the book"


def _tables(spark, hyps, refs):
    h = spark.createDataFrame([(i, t) for i, t in hyps.items()], "id long, text string") \
        .select("id", X.ws_tokens("text").alias("tokens"))
    r = spark.createDataFrame([(i, j, t) for i, rs in refs.items() for j, t in enumerate(rs)],
                              "id long, ref_no int, text string") \
        .select("id", "ref_no", X.ws_tokens("text").alias("tokens"))
    return h, r


def test_sentence_bleu_doctests(spark):
    h, r = _tables(spark, {1: H1, 2: H2}, {1: [R1, R2, R3], 2: [R1, R2, R3]})
    got = {x.id: x.bleu for x in B.sentence_bleu(h, r, ["id"]).collect()}
    assert got[1] == pytest.approx(0.504567, abs=1e-6)
    assert got[2] == pytest.approx(0.037031, abs=1e-6)   # method1 default
    five = {x.id: x.bleu for x in B.sentence_bleu(h, r, ["id"], max_n=5, weights=[0.2] * 5).collect()}
    assert five[1] == pytest.approx(0.392026, abs=1e-6)


def test_corpus_bleu_doctest(spark):
    h, r = _tables(spark, {1: H1, 2: H2B}, {1: [R1, R2, R3], 2: [R2A]})
    assert B.corpus_bleu(h, r, ["id"]).collect()[0].bleu == pytest.approx(0.592078, abs=1e-6)
    s = B.sentence_bleu(h, r, ["id"]).agg(F.avg("bleu")).collect()[0][0]
    assert s == pytest.approx(0.622325, abs=1e-6)


def test_modified_precision_the_cat(spark):
    h, r = _tables(spark, {1: "the the the the the the the"},
                   {1: ["the cat is on the mat", "there is a cat on the mat"]})
    m = B.precision_matches(h, r, ["id"], 1).collect()
    assert sum(x.m for x in m) == 2   # 2 / 7


def test_identical_text_scores_one(spark):
    h, r = _tables(spark, {1: "a b c d e"}, {1: ["a b c d e"]})
    assert B.corpus_bleu(h, r, ["id"]).collect()[0].bleu == pytest.approx(1.0)


def test_distinct_n_worked_case(spark):
    df = spark.createDataFrame([("a b a b",), ("",)], "t string")
    one = df.limit(1)
    got = [B.distinct_n(one, "t", n, X.ws_tokens).collect()[0][0] for n in (1, 2, 3)]
    assert got == [0.5, 0.5, 0.5]
    # an empty text adds 0 but still counts
    assert B.distinct_n(df, "t", 1, X.ws_tokens).collect()[0][0] == 0.25


def test_ngrams_short_input_is_empty(spark):
    df = spark.createDataFrame([(["x"],)], "t array<string>")
    assert df.select(X.ngrams("t", 2).alias("g")).collect()[0].g == []


def test_weighted_recall_order1_and_brevity(spark):
    h, r = _tables(spark, {1: "int y = 1"}, {1: ["int x = 1"]})
    s = B.weighted_recall_bleu(h, r, ["id"]).collect()[0]
    assert (s.num_1, s.den_1) == (pytest.approx(1.4), pytest.approx(1.6))
    h, r = _tables(spark, {1: "a b c"}, {1: ["a b c d e f g h i"]})
    d = B.weighted_recall_bleu(h, r, ["id"]).collect()[0]
    t = B.weighted_recall_bleu(h, r, ["id"], brevity="true_length").collect()[0]
    import math
    assert t.bleu == pytest.approx(d.bleu * math.exp(1 - 9 / 3))


def test_ws_tokens_match_python_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.t for r in docs.select("doc_id", X.ws_tokens("text").alias("t")).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == r.text.split()


def test_fixture_text_values(spark):
    from gradeframe.plans import catalog
    d = "/root/testdata/sf0.01"
    b1 = catalog.QUERIES["B1_corpus_bleu"](spark, d).collect()[0]
    assert (b1.num_1, b1.num_2, b1.num_3, b1.num_4, b1.ref_len) == (1497, 38, 8, 6, 7497)
    assert b1.bleu == pytest.approx(0.001103, abs=1e-6)
    b5 = catalog.QUERIES["B5_distinct_n"](spark, d).collect()[0]
    assert (b5.distinct_1, b5.distinct_2, b5.distinct_3) == (0.858484, 0.986603, 0.979671)


def _py_smooth(method, nums, dens, guesses, hyp_len, k=5.0, alpha=5.0, eps=0.1):
    """Plain-Python smoothing variants (as published) on (num, den) lists;
    the last entry is order N+1."""
    import math
    n = len(nums) - 1
    p = [nums[i] / dens[i] for i in range(n + 1)]
    if method == "method1":
        return [(nums[i] + eps) / dens[i] if nums[i] == 0 else p[i] for i in range(n)]
    if method == "method2":
        return [(nums[i] + 1) / (dens[i] + 1) for i in range(n)]
    if method == "method3":
        out, inc = [], 1
        for i in range(n):
            if nums[i] == 0:
                out.append(1 / (2 ** inc * dens[i])); inc += 1
            else:
                out.append(p[i])
        return out
    if method in ("method4", "method7"):
        out = [(i + k / math.log(hyp_len)) / dens[i] if nums[i] == 0 else p[i] for i in range(n)]
        if method == "method4":
            return out
        base, nxt = out, p
    else:
        base, nxt = p[:n], p
    if method in ("method5", "method7"):
        ext = base + [nxt[n]]
        m_prev, out = base[0] + 1, []
        for i in range(n):
            cur = (m_prev + base[i] + (ext[i + 1] if method == "method7" and i + 1 < n else nxt[i + 1])) / 3
            out.append(cur); m_prev = cur
        return out
    if method == "method6":
        out = p[:n]
        for i in range(2, n):
            pi0 = 0 if out[i - 2] == 0 else out[i - 1] ** 2 / out[i - 2]
            out[i] = (nums[i] + alpha * pi0) / (guesses[i] + alpha)
        return out


@pytest.mark.parametrize("method", ["method1", "method2", "method3", "method4", "method5",
                                    "method6", "method7"])
def test_sentence_smoothing_variants(spark, method):
    import math
    h, r = _tables(spark, {1: H1, 2: H2}, {1: [R1, R2, R3], 2: [R1, R2, R3]})
    got = {x.id: x.bleu for x in B.sentence_bleu(h, r, ["id"], smoothing=method).collect()}
    st = {x.id: x for x in B._stats(B.precision_matches(h, r, ["id"], 5), B.pair_lengths(h, r, ["id"]),
                                     ["id"], 5, True).collect()}
    for i in (1, 2):
        s = st[i]
        nums = [s[f"num_{k}"] for k in range(1, 6)]
        dens = [s[f"den_{k}"] for k in range(1, 6)]
        guesses = [s[f"guess_{k}"] for k in range(1, 6)]
        if method == "method6" and nums[2] == 0:
            assert got[i] is None
            continue
        p = _py_smooth(method, nums, dens, guesses, s.hyp_len)
        bp = 1.0 if s.hyp_len > s.ref_closest else math.exp(1 - s.ref_closest / s.hyp_len)
        exp = bp * math.exp(sum(0.25 * math.log(x) for x in p))
        assert got[i] == pytest.approx(exp, rel=1e-9), (i, method)


def test_single_and_multi_reference_paths_agree(spark):
    from gradeframe.plans import adapters as A
    p = A.text_pairs(spark, "/root/testdata/sf0.001")
    key = ["conv_id", "turn"]
    h, r = B.sides(p, key, "hyp", "ref", X.ws_tokens)
    multi = B.corpus_bleu(h, r, key).collect()[0]
    single = B.bleu_from_stats(B.pair_stats(p, key, "hyp", "ref", X.ws_tokens)).collect()[0]
    assert multi.bleu == pytest.approx(single.bleu, rel=1e-12)
    assert [multi[f"num_{k}"] for k in range(1, 5)] == [single[f"num_{k}"] for k in range(1, 5)]
    wm = B.weighted_recall_bleu(h, r, key).collect()[0]
    ws = B.weighted_bleu_from_stats(B.weighted_pair_stats(p, key, "hyp", "ref", X.ws_tokens)).collect()[0]
    assert wm.bleu == pytest.approx(ws.bleu, rel=1e-12)


def test_ngram_partitions_grow_with_the_text(spark):
    """A partition holds a bounded amount of text, however much there is."""
    text = " ".join(f"w{i}" for i in range(6000))
    pairs = spark.range(200).select("id", F.lit(text).alias("hyp"), F.lit("w1 w2 w9").alias("ref"))
    counts = B.pair_gram_counts(pairs, ["id"], "hyp", "ref", X.ws_tokens, 2)
    few = spark.conf.get("spark.sql.shuffle.partitions")
    assert counts.rdd.getNumPartitions() >= 200 * len(text) / B.PARTITION_BYTES > int(few)
    hyps, refs = B.sides(pairs, ["id"], "hyp", "ref", X.ws_tokens)
    assert B.precision_matches(hyps, refs, ["id"], 2).rdd.getNumPartitions() >= 200 * len(text) / B.PARTITION_BYTES
    one = B.pair_stats(pairs.where("id < 3"), ["id"], "hyp", "ref", X.ws_tokens).first()
    assert (one.num_1, one.num_2, one.num_3, one.hyp_len, one.pairs) == (9, 3, 0, 18000.0, 3)


def test_short_pairs_are_matched_in_their_row(spark, monkeypatch):
    """Only long texts and repeated keys become rows of n-grams; both ways give the same counts."""
    import random
    rng = random.Random(7)
    some = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, some(rng.randint(0, 12), ["int", "a", "b", "if"]), some(rng.randint(0, 12), ["int", "a", "b"])) for i in range(60)]
    rows += [(100, some(300, ["int", "a", "b"]), some(200, ["int", "a", "b"])), (101, None, "int a"), (102, "int a", None), (103, None, None),
             (104, "a b", "b c"), (104, "b c", "a b"), (104, None, "a"), (None, "a b", "a b"), (None, "x", "a b int"), (105, "", "  ")]
    pairs = spark.createDataFrame(rows, "id long, hyp string, ref string")
    long = []
    kept = B._gram_counts
    monkeypatch.setattr(B, "_gram_counts", lambda t, *a: long.append(t) or kept(t, *a))

    def counted():
        return sorted(map(tuple, B.pair_counts(pairs, ["id"], "hyp", "ref", X.ws_tokens, 4, ["int", "if"]).collect()), key=str)
    in_row = counted()
    assert sorted(r.id or 0 for r in long[0].collect()) == [0, 0, 100, 104, 104, 104]
    stats = [B.pair_stats(pairs, ["id"], "hyp", "ref", X.ws_tokens).first(), B.weighted_pair_stats(pairs, ["id"], "hyp", "ref", X.ws_tokens).first()]
    monkeypatch.setattr(B, "IN_ROW_BYTES", -1)
    assert counted() == in_row and len(in_row) == len({r[0] for r in rows})
    for s, as_rows in zip(stats, [B.pair_stats(pairs, ["id"], "hyp", "ref", X.ws_tokens).first(),
                                  B.weighted_pair_stats(pairs, ["id"], "hyp", "ref", X.ws_tokens).first()]):
        assert list(s) == pytest.approx(list(as_rows), rel=1e-12)
    # rows of one key: their n-grams together, not those of one text of that length
    twice = B.weighted_pair_stats(pairs.where("id = 104 and hyp is not null"), ["id"], "hyp", "ref", X.ws_tokens).first()
    assert (twice.den_2, twice.den_3, twice.num_2, twice.ref_closest) == (2.0, 0.0, 2.0, 4.0)
    by_id = {r[0]: r for r in in_row}
    h, r = rows[3][1].split(), rows[3][2].split()
    for k in (1, 2, 3, 4):
        hc, rc = (Counter(tuple(x[i:i + k]) for i in range(len(x) - k + 1)) for x in (h, r))
        assert by_id[3][2 + k] == sum((hc & rc).values())


def test_whitespace_tokens_split_as_python(spark):
    odd = [chr(c) for c in [*range(1, 0x100), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x180E, 0xFEFF, 0x3000, 0x3001]]
    texts = [f"a{c}b{c}{c} c" for c in odd] + ["", " ", " a  b ", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string") \
        .select("i", X.ws_tokens(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [None if t is None else t.split() for t in texts]
