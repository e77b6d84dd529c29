"""Structured Streaming entry point for grading.

Captured program output arrives as a stream of runs
``(submission_id, run, output)``.  Grading a run needs only that run and
its test cases, so every micro-batch is graded on its own with the batch
operators (:func:`output_to_lines` -> :func:`grade_tests` /
:func:`grade_summary`) inside ``foreachBatch`` and appended to parquet
sinks.  The checkpoint location (offsets + commit log) makes the query
restart exactly where it stopped after a failure; the sink writes are
idempotent per batch id because each batch overwrites only its own
``batch_id`` partition.  A row is a whole run: a run whose output is sent in
two rows is graded once in each micro-batch, on what that row holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.operators import grade as G


def grade_batch(raw: DataFrame, cases: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Grade one batch of raw outputs of ``run``: (per-test, per-run).  Only
    the test cases of the batch's submissions take part (semi join)."""
    lines = G.output_to_lines(raw.where(F.col("run") == run))
    subs = raw.where(F.col("run") == run).select("submission_id").distinct()
    c = cases.join(subs, "submission_id", "left_semi")
    texts = G.texts_from(c, lines)
    return (G.grade_tests_texts(texts, run=run, with_texts=False),
            G.grade_summary_texts(texts, run=run))


def start_grading_stream(raw_stream: DataFrame, cases: DataFrame, sink_dir: str,
                         checkpoint_dir: str, run: str = "gen", trigger: dict | None = None):
    """Start the streaming grading query; returns the StreamingQuery."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        tests, summary = grade_batch(batch, cases, run)
        for name, df in (("tests", tests), ("summary", summary)):
            (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
             .parquet(f"{sink_dir}/{name}"))

    w = raw_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
