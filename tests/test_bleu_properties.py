"""Property test: BLEU equals a plain-Python statement of the definition on
random multi-reference corpora (tiny vocabulary, so all orders match)."""

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gradeframe.functions import text as X
from gradeframe.operators import bleu as B

WORDS = st.lists(st.sampled_from(["a", "b", "c", "d"]), min_size=0, max_size=9)
PAIR = st.tuples(WORDS, st.lists(WORDS, min_size=1, max_size=3))


def grams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def py_stats(corpus, n_max=4):
    num, den = [0] * n_max, [0] * n_max
    hl = rl = 0
    for hyp, refs in corpus:
        for n in range(1, n_max + 1):
            hc = grams(hyp, n)
            mx = Counter()
            for r in refs:
                for g, c in grams(r, n).items():
                    mx[g] = max(mx[g], c)
            num[n - 1] += sum(min(c, mx[g]) for g, c in hc.items())
            den[n - 1] += max(1, sum(hc.values()))
        hl += len(hyp)
        rl += min((len(r) for r in refs), key=lambda x: (abs(x - len(hyp)), x))
    return num, den, hl, rl


def py_bleu(corpus, eps=0.1):
    num, den, hl, rl = py_stats(corpus)
    if num[0] == 0:
        return 0.0
    p = [(a + eps) / b if a == 0 else a / b for a, b in zip(num, den)]
    bp = 1.0 if hl > rl else (0.0 if hl == 0 else math.exp(1 - rl / hl))
    return bp * math.exp(sum(0.25 * math.log(x) for x in p))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PAIR, min_size=1, max_size=8))
def test_bleu_matches_definition(spark, corpus):
    hyps = spark.createDataFrame([(i, " ".join(h)) for i, (h, _) in enumerate(corpus)],
                                 "id long, text string").select("id", X.ws_tokens("text").alias("tokens"))
    refs = spark.createDataFrame([(i, j, " ".join(r)) for i, (_, rs) in enumerate(corpus)
                                  for j, r in enumerate(rs)], "id long, ref_no int, text string") \
        .select("id", "ref_no", X.ws_tokens("text").alias("tokens"))
    got = B.corpus_bleu(hyps, refs, ["id"]).collect()[0]
    assert got.bleu == pytest.approx(py_bleu(corpus), rel=1e-9, abs=1e-12)
    sent = {r.id: r.bleu for r in B.sentence_bleu(hyps, refs, ["id"]).collect()}
    for i, pair in enumerate(corpus):
        assert sent[i] == pytest.approx(py_bleu([pair]), rel=1e-9, abs=1e-12)
