"""Vector scoring (V1-V4, V7)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.operators import score as V


def test_mean_and_masked_mean(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (1, [3.0, 6.0], 0.0), (2, [5.0, 5.0], 1.0)],
                               "k long, v array<double>, m double")
    m = {r.k: r.mean for r in V.mean_vector(df, ["k"], "v").collect()}
    assert m == {1: [2.0, 4.0], 2: [5.0, 5.0]}
    p = {r.k: r.pooled for r in V.masked_mean_vector(df, ["k"], "v", "m").collect()}
    assert p[1] == pytest.approx([1.0, 2.0], rel=1e-6)


def test_head_logits(spark):
    df = spark.createDataFrame([(1, "p", [1.0, 2.0])], "id long, problem string, x array<double>")
    bank = spark.createDataFrame([("p", 1, [0.5, 1.0]), ("p", 2, [1.0, -1.0])],
                                 "problem string, test_no int, weights array<double>")
    out = {r.test_no: r.logit for r in V.head_logits(df, bank, ["problem"], "x",
                                                     head=["test_no"]).collect()}
    assert out == {1: 2.5, 2: -1.0}


def test_head_bank_recovers_weights(spark):
    rng = np.random.default_rng(0)
    rows = []
    for h, w in (("a", [2.0, -1.0]), ("b", [-1.5, 0.5])):
        for _ in range(400):
            x = rng.normal(size=2)
            p = 1 / (1 + np.exp(-(x @ np.array(w) + 0.3)))
            rows.append((h, [float(v) for v in x], int(rng.random() < p)))
    df = spark.createDataFrame(rows, "h string, v array<double>, y int")
    bank = {r.h: r for r in V.fit_head_bank(df, "h", "v", "y", reg=0.0).collect()}
    assert bank["a"].weights[0] > 1.0 and bank["a"].weights[1] < -0.5
    assert bank["b"].weights[0] < -1.0 and bank["b"].weights[1] > 0.2


def bank_rows(rng):
    heads = [("p", 3, rng.normal(size=4).tolist(), 0.5), ("p", 1, rng.normal(size=4).tolist(), -1.0), ("q", 7, rng.normal(size=4).tolist(), 0.0)]
    rows = [(i, rng.choice(["p", "q", "r"]), rng.normal(size=4).tolist()) for i in range(60)] + [(60, None, [1.0] * 4), (61, "p", None)]
    return heads, rows


@pytest.mark.parametrize("how", [{}, {"bank_bytes": 0, "salt_rows": 7}])
def test_bank_equals_plain_products(spark, how):
    heads, rows = bank_rows(np.random.default_rng(3))
    df = spark.createDataFrame([(i, str(p) if p is not None else None, x) for i, p, x in rows], "id long, problem string, x array<double>")
    bank = V.pack_bank(spark.createDataFrame(heads, "problem string, t int, w array<double>, b double"), "problem", "t", "w", "b")
    got = {r.id: r for r in V.bank_logits(df, bank, "problem", "x", **how).collect()}
    assert len(got) == len(rows)
    for i, p, x in rows:
        own = sorted((t, float(np.dot(x, w)) + b) for q, t, w, b in heads if q == p) if x is not None else []
        assert got[i].tests == [t for t, _ in own]
        assert got[i].logits == pytest.approx([z for _, z in own])
    flat = V.long_logits(V.bank_logits(df, bank, "problem", "x", **how), ["id"])
    assert flat.count() == sum(len(r.tests) for r in got.values())
    assert V.bank_logits(df.limit(0), bank, "problem", "x", **how).count() == 0


def test_bank_wants_vectors_of_its_width(spark):
    bank = V.pack_bank(spark.createDataFrame([("p", 1, [1.0, 2.0])], "problem string, t int, w array<double>"), "problem", "t", "w")
    for bad in ([1.0], [1.0, None]):
        df = spark.createDataFrame([("p", bad)], "problem string, x array<double>")
        with pytest.raises(Exception, match="vectors of 2 numbers"):
            V.bank_logits(df, bank, "problem", "x").collect()


def test_single_head_through_the_bank(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, x array<float>")
    assert {r.id: r.logit for r in V.single_head(df, "x", [0.5, -1.0], 0.25).collect()} == {1: -1.25, 2: None}
