"""Joins of scores within a tolerance against all pairs."""

import random

import pytest

from gradeframe.operators import curate as C


def plain(left, right, tol, how):
    out = []
    for k, r, s in right:
        own = [(k, s, ls, lid, r) for lk, lid, ls in left
               if lk == k and (ls is None and s is None or None not in (ls, s) and abs(ls - s) <= tol)]
        out += own or ([(k, s, None, None, r)] if how == "right" else [])
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["inner", "right"])
@pytest.mark.parametrize("tol", [0.5, 0.1, 3.0])
def test_join_within_equals_all_pairs(spark, how, tol):
    rng = random.Random(1)

    def rows(n):
        return [(rng.choice([1, 2, 3, None]), i, rng.choice([None, *[round(rng.randint(-8, 8) * tol / 2, 3) for _ in range(4)], rng.uniform(-3, 3)]))
                for i in range(n)]

    left, right = rows(60), rows(50)
    got = C.join_within(spark.createDataFrame(left, "k long, l long, score double"),
                        spark.createDataFrame(right, "k long, r long, score double"), ["k"], "score", tol, how)
    assert got.columns == ["k", "score", "score_left", "l", "r"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(left, right, tol, how)


def test_join_within_plans_no_pairs(spark):
    df = spark.createDataFrame([(1, 1, 1.0)], "k long, l long, score double")
    plan = C.join_within(df, df.withColumnRenamed("l", "r"), ["k"], "score", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        C.join_within(df, df.withColumnRenamed("l", "r"), ["k"], "score", 0.0)


def test_merge_with_tolerance_keeps_first(spark):
    orig = spark.createDataFrame([("s", "c", 0.3333, 5), ("s", "c", 0.3334, 2)], "student string, code string, score double, timestep long")
    more = spark.createDataFrame([("s", "c", 1 / 3, "p"), ("t", "d", 1.0, "q")], "student string, code string, score double, prompt string")
    got = C.merge_all_submissions(orig, more, ["student", "code"], ["student", "code", "timestep"], ["score_left"], "score", 1e-3)
    assert sorted(((r.student, r.timestep, r.prompt) for r in got.collect()), key=str) == [("s", 2, "p"), ("s", 5, "p"), ("t", None, "q")]
