"""Hot keys: results stay exact when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeframe.operators import grade as G
from gradeframe.operators import metrics as M
from gradeframe.operators import ordered as O


def test_grading_with_a_flooding_submission(spark):
    cases = spark.createDataFrame([(s, t, "1") for s in range(1, 6) for t in (1, 2, 3)],
                                  "submission_id long, test_no long, expected string")
    flood = spark.range(1, 50_001).select(F.lit(1).cast("long").alias("submission_id"),
                                          F.lit("gen").alias("run"), F.col("id").alias("line_no"),
                                          F.lit("1").alias("line"))
    normal = spark.createDataFrame([(s, "gen", t, "1" if t != 2 else "0") for s in range(2, 6)
                                    for t in (1, 2, 3)],
                                   "submission_id long, run string, line_no long, line string")
    s = {r.submission_id: (r.n_lines, r.score, r.status)
         for r in G.grade_summary(cases, flood.unionByName(normal), run="gen").collect()}
    assert s[1] == (50_000, 0.0, 1)       # at least 2x as many lines as tests
    assert all(s[k] == (3, pytest.approx(2 / 3), 1) for k in range(2, 6))


def test_auc_many_distinct_scores(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 1), rnd.random()) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = M.roc_auc(df, ranges=32).collect()[0].auc
    # brute force by ranks (scores are distinct)
    ranked = sorted(rows, key=lambda r: r[1])
    pos = sum(l for l, _ in rows)
    neg = len(rows) - pos
    rank_sum = sum(i + 1 for i, (l, _) in enumerate(ranked) if l == 1)
    exp = (rank_sum - pos * (pos + 1) / 2) / (pos * neg)
    assert got == pytest.approx(exp, abs=1e-12)


def test_global_sequence_number(spark):
    df = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("v"))
    got = O.sequence_number(df, [], ["v"], "rn", ranges=9)
    assert got.where(F.col("rn") != F.col("v") + 1).count() == 0


def test_prefix_sum_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 7).alias("g"),
                                  F.col("id").alias("o"), F.lit(1).alias("v"))
    got = O.ordered_prefix_sum(df, "o", "v", "c", by=["g"], ranges=5)
    ref = df.withColumn("c2", F.sum("v").over(Window.partitionBy("g").orderBy("o")))
    assert got.join(ref, ["g", "o"]).where(F.col("c") != F.col("c2")).count() == 0


def _range_sizes(df, by, order):
    return sorted(r["count"] for r in O.with_ranges(df, by, [F.col(c) for c in order], 16).groupBy("_range").count().collect())


def test_string_order_is_spread_and_exact(spark):
    df = spark.range(20_000).select(F.concat(F.lit("s"), F.lpad(((F.col("id") * 7919) % 20_000).cast("string"), 6, "0")).alias("k"))
    sizes = _range_sizes(df, [], ["k"])
    assert len(sizes) > 8 and sizes[-1] < 5_000
    got = O.sequence_number(df, [], ["k"], "rn", ranges=16)
    assert got.where(F.col("rn") != F.substring("k", 2, 6).cast("long") + 1).count() == 0


def test_leading_key_with_most_rows_is_spread_and_exact(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 20 > 0, F.col("id").cast("string")).alias("g"),
                                    ((F.col("id") * 7919) % 20_000).alias("o"))
    sizes = _range_sizes(df, ["g"], ["o"])
    assert len(sizes) > 8 and sizes[-1] < 5_000
    got = O.sequence_number(df, ["g"], ["o"], "rn", ranges=16, hot_rows=100)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("long"))
    assert got.exceptAll(want).count() == 0 and got.count() == 20_000      # the null group too


def test_split_keeps_rows_without_a_key(spark):
    from gradeframe.operators import sequence as S
    df = spark.createDataFrame([(None,), (None,), (1,), (2,), (3,)], "k long")
    got = S.split_exact(df, ["k"], 0.5, 1).collect()
    assert len(got) == 5 and all(r.split for r in got)
    assert len({r.split for r in got if r.k is None}) == 1


def test_hot_and_cold_groups_get_the_same_numbers(spark):
    """Groups beyond ``hot_rows`` are spread over ranges, the others not."""
    import random
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50), i) for i in range(600)]
    rows += [("c", None, 1000), ("c", 1, 1001)]
    df = spark.createDataFrame(rows, "g string, o long, i long")
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want.update({r[2]: n for n, r in enumerate(own, 1)})
    for hot_rows in (0, 150, 1_000_000):
        got = O.sequence_number(df, ["g"], ["o", "i"], "rn", ranges=7, hot_rows=hot_rows)
        assert got.columns == ["g", "o", "i", "rn"]
        assert {r.i: r.rn for r in got.collect()} == want
