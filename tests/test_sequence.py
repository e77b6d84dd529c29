"""Sequence operators (W, T) and the skew-safe ordered helpers."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeframe.operators import ordered as O
from gradeframe.operators import sequence as S


def test_segment_records_worked_case(spark):
    df = spark.createDataFrame([("s", i) for i in range(7)], "student string, ts long")
    rows = S.segment_records(df, "student", ["ts"], max_len=3).orderBy("ts").collect()
    assert [r.timestep for r in rows] == [0, 1, 2, 0, 1, 2, 0]
    assert [r.segment for r in rows] == [1, 1, 1, 2, 2, 2, 3]
    assert rows[4].seq_id == "s_2"


def test_sequence_number_hot_group_equals_row_number(spark):
    rnd = random.Random(3)
    # one hot student with most rows, ties in the first order column
    data = [(0 if rnd.random() < 0.7 else rnd.randint(1, 20), rnd.randint(0, 50), i)
            for i in range(2000)]
    df = spark.createDataFrame(data, "k long, ts long, id long")
    got = O.sequence_number(df, ["k"], ["ts", "id"], "rn", ranges=8, hot_rows=10)
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")))
    j = got.join(ref, ["k", "ts", "id"])
    assert j.where(F.col("rn") != F.col("rn2")).count() == 0
    assert j.count() == 2000


def test_ordered_prefix_sum_matches_brute_force(spark):
    rnd = random.Random(5)
    data = [(rnd.randint(0, 3), rnd.randint(0, 40), rnd.randint(1, 9)) for _ in range(800)]
    df = spark.createDataFrame(data, "g long, o long, v long")
    got = O.ordered_prefix_sum(df, "o", "v", "cum", by=["g"], ranges=6,
                               inclusive=False).collect()
    for r in got[:200]:
        exp = sum(v for g, o, v in data if g == r.g and o < r.o)
        assert r.cum == exp
    glob = O.ordered_prefix_sum(df, "o", "v", "cum", descending=True, ranges=5).collect()
    for r in glob[:200]:
        assert r.cum == sum(v for g, o, v in data if o >= r.o)


def test_dedupe_first_keeps_first_in_order(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 1, "c"), (None, 2, "x"), (None, 1, "y")],
                               "k long, o long, v string")
    rows = {r.k: r.v for r in S.dedupe_first(df, ["k"], ["o"]).collect()}
    assert rows == {1: "a", 2: "c", None: "y"}


def test_splits_disjoint_complete_and_sized(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("student"), "id")
    s = S.split_exact(df, ["student"], 0.2, seed=1)
    per = s.groupBy("student").agg(F.count_distinct("split").alias("n")).collect()
    assert all(r.n == 1 for r in per) and len(per) == 97
    sizes = {r.split: r.c for r in s.select("student", "split").distinct()
             .groupBy("split").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert sizes == {"train": 97 - 20, "valid": 10, "test": 10}
    assert s.count() == 1000


def test_pad_and_sequences(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("b", 0, 1)], "seq string, t int, y int")
    seqs = S.to_sequences(df, "seq", "t", ["y"])
    p = {r.seq: r.y for r in S.pad_sequences(seqs, {"y": -100}).collect()}
    assert p == {"a": [1, 0], "b": [1, -100]}


def test_sample_is_reproducible(spark):
    df = spark.range(500)
    a = [r.id for r in S.sample_n(df, 20, 42, ["id"]).collect()]
    b = [r.id for r in S.sample_n(df, 20, 42, ["id"]).collect()]
    assert a == b and len(set(a)) == 20


def test_fixture_segment_counts(spark):
    from gradeframe.plans import catalog
    w1 = catalog.QUERIES["W1_segment_records"](spark, "/root/testdata/sf0.01")
    r = w1.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq_id").alias("segs"),
               F.max("timestep").alias("mx"), F.count_if(F.col("timestep") == 0).alias("z")).collect()[0]
    assert (r.n, r.segs, r.mx, r.z) == (10000, 569, 19, 569)
    assert catalog.QUERIES["W2_first_submission"](spark, "/root/testdata/sf0.01").count() == 750


def test_pad_steps_in_two_dimensions(spark):
    rows = [("a", [[1, 0], [1]], [7, 8], [[0.5, 1.0], [2.0, 3.0]], ["x", "y"]), ("b", [[0, 1, 1]], [9], [[1.0, 1.0]], ["z"]),
            ("c", [], [], [], []), ("d", None, [1, 2, 3], None, None), ("e", [None, [1]], [4, 5], [[1.0, 2.0]], ["q"])]
    df = spark.createDataFrame(rows, "k string, labels array<array<int>>, problems array<long>, inputs array<array<double>>, codes array<string>")
    out = {r.k: r for r in S.pad_steps(df, {"labels": -100, "inputs": 0.0}, {"problems": 0, "codes": ""}).collect()}
    assert out["a"].labels == [[1, 0, -100], [1, -100, -100], [-100] * 3]
    assert out["b"].labels == [[0, 1, 1], [-100] * 3, [-100] * 3] and out["b"].problems == [9, 0, 0]
    assert out["c"].labels == out["d"].labels == [[-100] * 3] * 3 and out["d"].problems == [1, 2, 3]
    assert out["a"].inputs == [[0.5, 1.0], [2.0, 3.0], [0.0, 0.0]] and out["a"].codes == ["x", "y", ""]
    assert out["e"].labels == [[-100] * 3, [1, -100, -100], [-100] * 3]
    wide = S.pad_steps(df, {"labels": -100}, widths={"labels": 5}, length=4).where("k = 'b'").first()
    assert wide.labels == [[0, 1, 1, -100, -100], *[[-100] * 5] * 3]
    assert S.pad_steps(df.limit(0), {"labels": -100}).count() == 0


def test_pad_sequences_length_over_all_columns(spark):
    df = spark.createDataFrame([([1], ["a", "b", "c"]), ([1, 2], ["d"])], "x array<int>, y array<string>")
    assert sorted(tuple(map(tuple, r)) for r in S.pad_sequences(df, {"x": 0, "y": ""}).collect()) == [
        ((1, 0, 0), ("a", "b", "c")), ((1, 2, 0), ("d", "", ""))]


def test_unit_hash_is_the_md5_prefix(spark):
    import hashlib
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "k long, v string")
    for r in df.withColumn("u", S.unit_hash(["k", "v"], 9)).collect():
        text = "9|" + "|".join("-" if x is None else f"={x}" for x in (r.k, r.v))
        assert r.u == int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2 ** 52


def test_split_keeps_students_without_id(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else i % 10, i) for i in range(100)], "s long, i long")
    got = S.split_exact(df, ["s"], 0.2, 1).collect()
    assert len(got) == 100 and len({r.split for r in got if r.s is None}) == 1
    assert {x: len({r.s for r in got if r.split == x}) for x in ("train", "valid", "test")} == {"train": 8, "valid": 1, "test": 1}
