"""Metrics (M1-M7, A6-A8, P12) against worked cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.operators import metrics as M


def _auc_brute(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("labels,scores,auc", [
    ([0, 0, 1, 1], [.1, .4, .35, .8], 0.75),
    ([0, 1, 1, 0], [.5, .5, .7, .2], 0.875),
])
def test_auc_cases(spark, labels, scores, auc):
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    assert M.roc_auc(df).collect()[0].auc == pytest.approx(auc)


def test_auc_brute_force_many_ties(spark):
    rnd = random.Random(7)
    labels = [rnd.randint(0, 1) for _ in range(600)]
    scores = [round(rnd.random(), 2) for _ in range(600)]
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    # few buckets to force several value ranges in the distributed prefix sum
    got = M.roc_auc(df, ranges=7).collect()[0].auc
    assert got == pytest.approx(_auc_brute(labels, scores), abs=1e-12)
    assert 0.0 <= got <= 1.0


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, .3), (1, .4)], "label int, score double")
    assert M.roc_auc(df).collect()[0].auc is None


def test_pass_rate_mse(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (1, 0, 0), (1, None, 1)],
                               "submission_id long, label int, pred int")
    assert M.pass_rate_mse(df).collect()[0].mse == pytest.approx((2 / 3 - 1 / 3) ** 2)


def test_predict_label_strict(spark):
    df = spark.createDataFrame([(0.0,), (0.01,)], "logit double")
    assert [r.p for r in df.select(M.predict_label("logit").alias("p")).collect()] == [0, 1]


def test_f1_empty_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")
    assert M.f1(df).collect()[0].f1 == 0.0


def test_bce_matches_python(spark):
    rows = [(-3.0, 1), (0.5, 0), (2.0, 1), (10.0, 0)]
    df = spark.createDataFrame(rows, "logit double, label int")
    exp = sum(-(y * math.log(1 / (1 + math.exp(-z))) + (1 - y) * math.log(1 - 1 / (1 + math.exp(-z))))
              for z, y in rows) / len(rows)
    assert M.bce_with_logits(df).collect()[0].bce == pytest.approx(exp, rel=1e-9)


def test_welch(spark):
    a = [1.0, 2.0, 3.0, 4.0, 5.5]
    b = [2.0, 4.0, 6.0, 9.0]
    df = spark.createDataFrame([(0, x) for x in a] + [(1, x) for x in b], "g int, v double")
    r = M.welch_t(df, "v", "g", 0, 1).collect()[0]
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    va = sum((x - ma) ** 2 for x in a) / (len(a) - 1)
    vb = sum((x - mb) ** 2 for x in b) / (len(b) - 1)
    t = (ma - mb) / math.sqrt(va / len(a) + vb / len(b))
    assert r.t == pytest.approx(t)
    p = M.welch_p_value(r.t, r.df)
    assert 0.0 < p < 1.0


def test_fixture_metric_values(spark):
    from gradeframe.plans import catalog
    d = "/root/testdata/sf0.01"
    q = catalog.QUERIES
    assert q["M4_roc_auc"](spark, d).collect()[0].auc == 0.498976
    assert q["M1_accuracy"](spark, d).collect()[0].accuracy == 0.49915
    assert q["M2_f1"](spark, d).collect()[0].f1 == 0.472058
    r = q["M6_pass_rate_mse"](spark, d).collect()[0]
    assert (r.mse, r.n_submissions) == (0.166278, 14743)


@pytest.mark.parametrize("t,dof,p", [(2.228, 10, 0.05), (2.0, 10, 0.0734), (1.96, 1e6, 0.05),
                                     (3.0, 3, 0.0577), (0.0, 5, 1.0), (-2.0, 10, 0.0734)])
def test_welch_p_value_known(t, dof, p):
    assert M.welch_p_value(t, dof) == pytest.approx(p, abs=1e-4)


def test_histogram_auc_is_within_its_bound(spark):
    import random
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.4), rng.gauss(0, 1)) for _ in range(400)] + [(None, 1.0), (1, None), (1, 9.0), (0, 9.0)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos = [s for y, s in rows if y == 1 and s is not None]
    neg = [s for y, s in rows if y == 0]
    exact = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    for bins in (1, 4, 64, 1 << 16):
        r = M.roc_auc_histogram(df, bins=bins).first()
        assert abs(r.auc - exact) <= r.bound + 1e-12
    assert r.bound < 1e-3 and M.roc_auc_histogram(df, bins=1).first().bound == pytest.approx(0.5)
    cut = M.roc_auc_histogram(df, bins=64, low=-1.0, high=1.0).first()
    assert abs(cut.auc - exact) <= cut.bound
    one = M.roc_auc_histogram(df.where("label = 1")).first()
    assert one.auc is None and one.bound is None
    same = spark.createDataFrame([(0, 1.0), (1, 1.0)], "label int, score double")
    assert tuple(M.roc_auc_histogram(same).first()) == (0.5, 0.5)
    assert M.roc_auc_histogram(df.limit(0)).first().auc is None


def test_p_value_column_equals_quadrature(spark):
    cases = [(t, dof) for t in (-3.2, 0.0, 1e-6, 0.3, 1.0, 2.5, 12.0, 300.0) for dof in (1.0, 2.0, 5.5, 30.0, 999.3, 1e6)]
    df = spark.createDataFrame(cases, "t double, dof double").withColumn("p", M.student_p(F.col("t"), F.col("dof")))
    for r in df.collect():
        assert r.p == pytest.approx(M.welch_p_value(r.t, r.dof), rel=1e-6, abs=1e-12), r
    # below one degree of freedom, with the singularity at 0 taken out
    node, weight = np.polynomial.legendre.leggauss(200)
    top = math.atan2(math.sqrt(0.7), 3.2) ** 0.7
    u = (top * (node + 1) / 2) ** (1 / 0.7)
    area = ((np.sin(u) / u) ** -0.3 * weight).sum() * top / 2 / 0.7
    want = 2 * area / math.exp(math.lgamma(0.35) + math.lgamma(0.5) - math.lgamma(0.85))
    few = spark.createDataFrame([(-3.2, 0.7)], "t double, dof double")
    assert few.select(M.student_p(F.col("t"), F.col("dof"))).first()[0] == pytest.approx(want, rel=1e-8)
    edge = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0), (float("inf"), 3.0)], "t double, dof double")
    assert [r.p for r in edge.select(M.student_p(F.col("t"), F.col("dof")).alias("p")).collect()] == [None, None, None, 0.0]


def test_best_epoch_reports_other_splits(spark):
    log = spark.createDataFrame([(0, "valid", 2.0, 0.5), (1, "valid", 1.0, 0.6), (2, "valid", 1.0, 0.9), (1, "test", 7.0, 0.1),
                                 (2, "test", 5.0, 0.2), (0, "train", 3.0, None), (3, "test", 0.0, 1.0)],
                                "epoch long, split string, loss_batch_mean double, acc double")
    r = M.best_epoch(log, report={"test": ["loss_batch_mean", "acc"], "train": ["acc"]}).first()
    assert tuple(r) == (1, 1.0, 7.0, 0.1, None)
    assert tuple(M.best_epoch(log).first()) == (1, 1.0)


def test_accuracy_of_a_log_without_elements(spark):
    log = spark.createDataFrame([(0, "a", 1.0, 0, 0), (0, "b", 1.0, 1, 2)], "epoch long, split string, loss double, acc_hits long, acc_n long")
    assert {r.split: r.acc for r in M.aggregate_log(log).collect()} == {"a": None, "b": 0.5}
