"""Sources and sinks."""

import os

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeframe.sources import io as S
from gradeframe.sources import records as R


def test_bad_lines_too_many_fields_only(spark, tmp_path):
    p = tmp_path / "cases.csv"
    p.write_text("coding_prompt_id,input,expected_output\n"
                 "1,a\n"                 # short: kept with NULL
                 "2,b,x\n"               # normal
                 "3,c,y,EXTRA\n"         # too long: rejected
                 "4,d,z,\n"              # too long with an empty extra field
                 "nan,e,w\n")            # NaN id: removed by P11
    good, bad = S.read_cases(spark, str(p), on_bad="warn")
    ids = sorted(r.coding_prompt_id for r in good.collect())
    assert ids == [1, 2]
    assert sorted(r.input for r in bad.collect()) == ["c", "d"]
    assert S.read_cases(spark, str(p)).count() == 2


def test_flatten_cuts_to_shortest(spark):
    df = spark.createDataFrame(
        [("s1", (["c1", "c2", "c3"], [1.0, 0.5]))],
        "student string, v struct<codes: array<string>, scores: array<double>>")
    rows = S.flatten_nested(df, "student", "v", ["codes", "scores"]).collect()
    assert [(r.codes, r.scores) for r in rows] == [("c1", 1.0), ("c2", 0.5)]


def test_nest_roundtrip_with_chunks(spark):
    df = spark.range(25).select((F.col("id") % 2).alias("student"), F.col("id").alias("ts"),
                                (F.col("id") * 10).alias("code"))
    nested = S.nest_by_key(df, "student", ["ts"], ["code"], max_items=5)
    assert nested.where("student = 0").count() == 3   # 13 rows in chunks of 5
    flat = nested.select("student", F.explode("code").alias("code"))
    assert flat.count() == 25


def test_chunked_export(spark, tmp_path):
    df = spark.range(5000).repartition(1)
    out = str(tmp_path / "chunks")
    S.write_chunks(df, out, rows=2000)
    files = [f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet")]
    assert len(files) == 3
    assert spark.read.parquet(out).count() == 5000
    ids = {r.chunk: r.c for r in S.with_chunk_id(spark.range(4500), ["id"], 2000)
           .groupBy("chunk").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert ids == {0: 2000, 1: 2000, 2: 500}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    S.write_csv(df, str(tmp_path / "c"))
    S.write_results(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    assert spark.read.json(str(tmp_path / "j")).collect()[0].v == "a"


def test_events_strict(spark, tmp_path):
    p = tmp_path / "main.csv"
    p.write_text(",".join(S.EVENT_COLUMNS) + "\n" +
                 "s1,1,2,cs1,2024-01-01 00:00:00,Run.Program" + "," * 13 + "\n")
    df = S.read_events(spark, str(p))
    r = df.collect()[0]
    assert r.SubjectID == "s1" and r.ProblemID == 2 and r.EventType == "Run.Program"


def test_positions_run_on_over_chunks(spark):
    df = spark.range(25).select(F.lit(1).alias("student"), F.col("id").alias("ts"), (F.col("id") * 10).alias("code"))
    nested = S.nest_by_key(df, "student", ["ts"], ["code"], max_items=10)
    flat = S.flatten_nested(nested.select("student", "first_pos", F.struct("code").alias("v")), "student", "v", ["code"], "first_pos")
    assert sorted((r.pos, r.code) for r in flat.collect()) == [(i, i * 10) for i in range(25)]


def small_splits(spark, size):
    """Files cut into splits of ``size`` bytes, for the time of a test."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    return kept


def restore(spark, kept):
    for k, v in kept.items():
        spark.conf.set(k, v)


def messy_csv(rng):
    def field():
        return rng.choice(['"x\ny"', '"a,b"', '"say ""hi"""', '""""', '""', '"' + "l1\nl2\n\nl4" * rng.randint(1, 30) + '"',
                           '5" disk', 'a"b"c', 'end"', "", "plain", "été", " spaced "])

    rows = ["a,b,c"]
    for i in range(120):
        n = 3 if i == 0 else rng.choice([1, 2, 3, 3, 3, 3, 4, 5])
        rows.append(",".join([f"k{i}", *(field() for _ in range(n - 1))]))
    return "".join(r + rng.choice(["\n", "\n", "\r\n", "\n\n"]) for r in rows)


@pytest.mark.parametrize("seed, split", [(1, 300), (2, 77), (3, 1000), (4, 1 << 20)])
def test_records_equal_pandas_at_any_split(spark, tmp_path, seed, split):
    p = tmp_path / "messy.csv"
    p.write_bytes(messy_csv(random.Random(seed)).encode())
    kept = small_splits(spark, split)
    try:
        rows = R.read_csv(spark, str(p), ["a", "b", "c"]).collect()
    finally:
        restore(spark, kept)
    want = pd.read_csv(p, dtype=str, on_bad_lines="skip", index_col=False)
    want = [tuple(None if pd.isna(x) else x for x in r) for r in want.itertuples(index=False)]
    assert sorted((tuple(r[:3]) for r in rows if not r.too_long), key=str) == sorted(want, key=str)
    assert all(r.line.startswith(r.a + ",") for r in rows if r.too_long)


def test_scan_follows_quotes():
    assert R.scan('a,"b', False) == (True, 1)
    assert R.scan('b""c', True) == (True, 0)
    assert R.scan('b",c,"d', True) == (True, 2)
    assert R.scan('5" disk,x', False) == (False, 1)
    assert R.scan("", True) == (True, 0) and R.scan("", False) == (False, 0)


def test_records_of_empty_and_unclosed_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "open.csv").write_text('a,b\n1,"x\ny\n')
    (tmp_path / "header.csv").write_text("a,b\n")
    assert R.read_csv(spark, str(tmp_path / "empty.csv"), ["a", "b"]).count() == 0
    assert R.read_csv(spark, str(tmp_path / "header.csv"), ["a", "b"]).count() == 0
    rows = R.read_records(spark, str(tmp_path / "open.csv")).where("not first").collect()
    assert [r.record for r in rows] == ['1,"x\ny']
    # headers of several files, and no setting changed
    (tmp_path / "d").mkdir()
    for i in range(3):
        (tmp_path / "d" / f"{i}.csv").write_text(f"a,b\n{i},z\n")
    assert sorted(r.a for r in R.read_csv(spark, str(tmp_path / "d"), ["a", "b"]).collect()) == ["0", "1", "2"]
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == "true"


def test_events_short_and_long_rows(spark, tmp_path):
    p = tmp_path / "main.csv"
    p.write_text(",".join(S.EVENT_COLUMNS) + "\ns1,1,2,cs1\n")
    assert [r.ServerTimestamp for r in S.read_events(spark, str(p)).collect()] == [None]
    p.write_text(",".join(S.EVENT_COLUMNS) + "\ns1" + "," * 19 + "\n")
    with pytest.raises(Exception, match="more than 19 fields: s1"):
        S.read_events(spark, str(p)).collect()


def test_rejects_keep_their_text(spark, tmp_path):
    p = tmp_path / "cases.csv"
    p.write_text('coding_prompt_id,input,expected_output\n1,"a\nb",c,\n2,x,y,,,\n3,x\n')
    good, bad = S.read_cases(spark, str(p), on_bad="warn")
    assert sorted(r.line for r in bad.collect()) == ['1,"a\nb",c,', "2,x,y,,,"]
    assert [tuple(r) for r in good.collect()] == [(3, "x", None)]


def test_shards_of_different_schemas(spark, tmp_path):
    paths = [str(tmp_path / f"s{i}") for i in range(4)]
    for path, df in zip(paths, [spark.range(2).selectExpr("id", "cast(id as int) as n"), spark.range(2).selectExpr("1.5d as n", "id"),
                                spark.range(1).selectExpr("id", "'x' as extra"), spark.range(1).selectExpr("cast(id as int) as id")]):
        df.write.parquet(path)
    rows = S.read_shards(spark, paths, "shard").collect()
    assert sorted((r.shard, r.id, r.n, r.extra) for r in rows if r.n is not None) == [
        ("s0", 0, 0.0, None), ("s0", 1, 1.0, None), ("s1", 0, 1.5, None), ("s1", 1, 1.5, None)]
    assert sorted((r.shard, r.extra) for r in rows if r.n is None) == [("s2", "x"), ("s3", None)]
    spark.range(1).selectExpr("'a' as id").write.parquet(str(tmp_path / "text"))
    with pytest.raises(ValueError, match="shards hold id"):
        S.read_shards(spark, [paths[0], str(tmp_path / "text")])


def test_chunk_files_hold_consecutive_rows(spark, tmp_path):
    df = spark.range(4500).select((F.lit(4500) - F.col("id")).alias("k"), F.lit("x").alias("v")).repartition(7)
    manifest = S.write_chunks(df, str(tmp_path / "c"), 2000, ["k"]).orderBy("chunk").collect()
    assert [(r.chunk, r.rows) for r in manifest] == [(0, 2000), (1, 2000), (2, 500)]
    back = spark.read.parquet(str(tmp_path / "c")).groupBy("chunk").agg(F.min("k").alias("a"), F.max("k").alias("z")).orderBy("chunk")
    assert [(r.a, r.z) for r in back.collect()] == [(1, 2000), (2001, 4000), (4001, 4500)]
