"""Streaming grading over a file stream (micro-batches via foreachBatch)."""

from pyspark.sql import functions as F

from gradeframe.streaming.grading import start_grading_stream


def test_stream_grades_every_run(spark, tmp_path):
    src = tmp_path / "in"
    raw = spark.createDataFrame([(1, "gen", "1\n2\n"), (2, "gen", "1\n9\n"), (3, "gen", "Timeout")],
                                "submission_id long, run string, output string")
    raw.write.parquet(str(src / "part1"))
    cases = spark.createDataFrame([(s, t, str(t)) for s in (1, 2, 3) for t in (1, 2)],
                                  "submission_id long, test_no long, expected string")
    stream = spark.readStream.schema(raw.schema).parquet(str(src / "*"))
    q = start_grading_stream(stream, cases, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                             trigger={"availableNow": True})
    q.awaitTermination(120)
    s = {r.submission_id: r.score for r in spark.read.parquet(str(tmp_path / "out/summary")).collect()}
    assert s == {1: 1.0, 2: 0.5, 3: 0.0}
    t = spark.read.parquet(str(tmp_path / "out/tests"))
    assert t.count() == 6 and t.where(F.col("passed") == 1).count() == 3


def test_stream_restart_processes_only_new_files(spark, tmp_path):
    src = tmp_path / "in"
    schema = "submission_id long, run string, output string"
    spark.createDataFrame([(1, "gen", "1\n")], schema).write.parquet(str(src / "a"))
    cases = spark.createDataFrame([(1, 1, "1"), (2, 1, "1")],
                                  "submission_id long, test_no long, expected string")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(src / "*"))
        q = start_grading_stream(stream, cases, out, ck, trigger={"availableNow": True})
        q.awaitTermination(120)

    run()
    spark.createDataFrame([(2, "gen", "0\n")], schema).write.parquet(str(src / "b"))
    run()
    s = spark.read.parquet(out + "/summary")
    assert sorted((r.submission_id, r.score) for r in s.collect()) == [(1, 1.0), (2, 0.0)]
    assert s.select("batch_id").distinct().count() == 2
