"""Grading of captured program output, test case by test case.

Canonical inputs
----------------
cases : (key, test_no, expected)          one row per test of a submission
lines : (key, run, line_no, line)         captured output, one row per line

Plan shape (why it scales)
--------------------------
Cases and output lines are *unioned* and aggregated twice: first by
``(key, position, text)`` -- an expected output and a captured line are
equal exactly when they fall into the same group, so string equality is
decided by hash grouping -- then by ``key``.  Both are hash aggregates
with map-side partial aggregation, so a single submission that prints
billions of lines never lands in one task: its rows are spread over
positions and texts in the first shuffle and pre-counted per map task
before the second.  There is no join between cases and lines and no
per-submission array.  (Per-test output with the texts, G2, aligns by
position instead.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.functions.codetext import main_function

KEY = "submission_id"


def output_to_lines(raw: DataFrame, key: str = KEY, output: str = "output") -> DataFrame:
    """X9 + X10: raw program output text -> one row per line.

    The text is split on ``\\n`` and the last element dropped (the text ends
    with a newline).  Failed runs (``compilation failed`` in the text, or a
    time-out marker compared case-insensitively, D13) yield no lines.
    """
    o = F.col(output)
    failed = o.isNull() | o.contains("compilation failed") | (F.upper(o) == "TIMEOUT")
    parts = F.split(o, "\n")
    body = F.when(failed | (F.size(parts) <= 1), F.array().cast("array<string>")) \
        .otherwise(F.slice(parts, 1, F.size(parts) - 1))
    keep = [c for c in raw.columns if c != output]
    return (raw.select(*keep, F.posexplode(body).alias("pos", "line"))
               .withColumn("line_no", (F.col("pos") + 1).cast("long")).drop("pos"))


def failed_run(output: str = "output"):
    """X10 as a column: True when the run produced no usable output."""
    o = F.col(output)
    return o.contains("compilation failed") | (F.upper(o) == "TIMEOUT")


EXPECTED = "expected"


def texts_from(cases: DataFrame, lines: DataFrame, key: str = KEY) -> DataFrame:
    """The canonical long form of grading input: (key, source, pos, text),
    where source is ``'expected'`` for test cases and the run name for
    captured lines.  Producers that hold both in one table (one scan) can
    build this directly and use the ``*_texts`` operators."""
    c = cases.select(key, F.lit(EXPECTED).alias("source"), F.col("test_no").cast("long").alias("pos"),
                     F.col("expected").cast("string").alias("text"))
    ln = lines.select(key, F.col("run").alias("source"), F.col("line_no").cast("long").alias("pos"),
                      F.col("line").cast("string").alias("text"))
    return c.unionByName(ln)


def aligned_texts(texts: DataFrame, runs: list[str], key: str = KEY) -> DataFrame:
    """(key, pos, expected, line_<run>..., _is_test, _has_<run>...) with one
    row per position that holds a test or any captured line.  Presence is
    counted from the source tag, so NULL texts still count as present."""
    src = F.col("source")
    aggs = [F.max(F.when(src == EXPECTED, F.col("text"))).alias("expected"),
            F.sum(F.when(src == EXPECTED, 1).otherwise(0)).alias("_is_test")]
    for r in runs:
        aggs += [F.max(F.when(src == r, F.col("text"))).alias(f"line_{r}"),
                 F.sum(F.when(src == r, 1).otherwise(0)).alias(f"_has_{r}")]
    return texts.where(src.isin(EXPECTED, *runs)).groupBy(key, "pos").agg(*aggs)


def text_flags(texts: DataFrame, runs: list[str], key: str = KEY) -> DataFrame:
    """(key, pos, text, _e, _r0, _r1, ...): how many expected outputs and
    lines of each run carry exactly this text at this position.

    Equality of an expected output and a captured line is decided by the
    grouping itself (same text -> same group), so the aggregate is a hash
    aggregate on (key, pos, text) with map-side partial counts, and exact.
    """
    src = F.col("source")
    aggs = [F.sum(F.when(src == EXPECTED, 1).otherwise(0)).alias("_e")]
    aggs += [F.sum(F.when(src == r, 1).otherwise(0)).alias(f"_r{i}") for i, r in enumerate(runs)]
    return texts.where(src.isin(EXPECTED, *runs)).groupBy(key, "pos", "text").agg(*aggs)


def _flag_hit(i: int):
    """At an expected-output row: 1 when run ``i`` printed that same
    (non-NULL) text at that position."""
    return F.when(F.col("text").isNotNull() & (F.col(f"_r{i}") > 0), 1).otherwise(0)


def _hit(run: str):
    """1 when the captured line at this test equals the expected output."""
    return F.when(F.col(f"line_{run}") == F.col("expected"), 1).otherwise(0)


def grade_summary(cases: DataFrame, lines: DataFrame, run: str = "gt",
                  key: str = KEY) -> DataFrame:
    """G1 over a table: per submission (n_tests, n_lines, hits, score, status).

    score = hits / n_tests unless the run has no output or at least twice as
    many lines as tests, then 0.  A missing line counts as a fail (D10).
    status (G4): 0 no output, 2 every test passes, else 1.
    """
    return grade_summary_texts(texts_from(cases, lines, key), run, key)


def grade_summary_texts(texts: DataFrame, run: str = "gt", key: str = KEY) -> DataFrame:
    """G1 on the long text table (see :func:`texts_from`): two hash
    aggregates, by (key, pos, text) and by key."""
    f = text_flags(texts, [run], key)
    e = F.col("_e") > 0
    s = f.groupBy(key).agg(
        F.sum("_e").alias("n_tests"),
        F.sum("_r0").alias("n_lines"),
        F.sum(F.when(e, _flag_hit(0)).otherwise(0)).alias("hits"),
    ).where(F.col("n_tests") > 0)
    ok = (F.col("n_lines") > 0) & (F.col("n_lines") < 2 * F.col("n_tests"))
    score = F.when(ok, F.col("hits").cast("double") / F.col("n_tests")).otherwise(F.lit(0.0))
    return (s.withColumn("score", score)
             .withColumn("status", run_status(F.col("n_lines"), F.col("score"))))


def run_status(n_lines, score):
    """0 = no output, 2 = all tests pass, 1 = partial."""
    return (F.when(n_lines == 0, F.lit(0))
             .when(score == 1.0, F.lit(2)).otherwise(F.lit(1)))


def grade_tests(cases: DataFrame, lines: DataFrame, run: str = "gt",
                key: str = KEY) -> DataFrame:
    """One row per (submission, test) with ``passed`` after the run-level
    rules of G1 (no output / too many lines -> every test fails)."""
    return grade_tests_texts(texts_from(cases, lines, key), run, key)


def grade_tests_texts(texts: DataFrame, run: str = "gt", key: str = KEY,
                      with_texts: bool = True) -> DataFrame:
    """G2 on the long text table (see :func:`texts_from`).

    ``with_texts=False`` returns (key, test_no, hit, passed, n_tests,
    n_lines) from the hash aggregate on (key, pos, text) alone; with the
    texts, positions are aligned to carry expected and printed line.
    """
    if with_texts:
        a = aligned_texts(texts, [run], key)
        tests = a.where(F.col("_is_test") > 0).select(
            key, F.col("pos").alias("test_no"), "expected",
            F.col(f"line_{run}").alias("line"), _hit(run).alias("hit"))
    else:
        f = text_flags(texts, [run], key)
        tests = f.where(F.col("_e") > 0).select(key, F.col("pos").alias("test_no"),
                                                _flag_hit(0).alias("hit"))
    summ = grade_summary_texts(texts, run, key).select(key, "n_tests", "n_lines")
    ok = (F.col("n_lines") > 0) & (F.col("n_lines") < 2 * F.col("n_tests"))
    # per-test rows join the one-row-per-submission summary: N:1, and AQE's
    # skew-join split handles a submission with very many tests.
    return (tests.join(summ, key)
                 .withColumn("passed", F.when(ok, F.col("hit")).otherwise(F.lit(0))))


def compare_runs(cases: DataFrame, lines: DataFrame, gt: str = "gt", gen: str = "gen",
                 key: str = KEY) -> DataFrame:
    """G3 + G6 inputs: one row per submission comparing two runs.

    Columns: n_tests, gt_lines, gen_lines, gt_score, gen_score, gt_status,
    gen_status, agreement, and the per-test confusion counts tp/fp/fn/tn of
    gen's pass/fail against gt's (after the G1 run rules).

    agreement (G3): both runs without output -> 1, one without -> 0, else the
    share of tests where plain positional pass/fail agrees (no 2x rule).
    """
    return compare_texts(texts_from(cases, lines, key), gt, gen, key)


def compare_texts(texts: DataFrame, gt: str = "gt", gen: str = "gen", key: str = KEY) -> DataFrame:
    """G3 + G6 inputs on the long text table (see :func:`compare_runs`)."""
    f = text_flags(texts, [gt, gen], key)
    t = F.col("_e") > 0
    hg, he = _flag_hit(0), _flag_hit(1)
    s = f.groupBy(key).agg(
        F.sum("_e").alias("n_tests"),
        F.sum("_r0").alias("gt_lines"),
        F.sum("_r1").alias("gen_lines"),
        F.sum(F.when(t, hg).otherwise(0)).alias("_gh"),
        F.sum(F.when(t, he).otherwise(0)).alias("_eh"),
        F.sum(F.when(t, hg * he).otherwise(0)).alias("_both"),
        F.sum(F.when(t & (hg == he), 1).otherwise(0)).alias("_same"),
    ).where(F.col("n_tests") > 0)
    n = F.col("n_tests")
    gok = ((F.col("gt_lines") > 0) & (F.col("gt_lines") < 2 * n)).cast("long")
    eok = ((F.col("gen_lines") > 0) & (F.col("gen_lines") < 2 * n)).cast("long")
    gs = (F.col("_gh") * gok).cast("double") / n
    es = (F.col("_eh") * eok).cast("double") / n
    tp = F.col("_both") * gok * eok
    fp = F.col("_eh") * eok - tp
    fn = F.col("_gh") * gok - tp
    agreement = (F.when((F.col("gt_lines") == 0) & (F.col("gen_lines") == 0), F.lit(1.0))
                  .when((F.col("gt_lines") == 0) | (F.col("gen_lines") == 0), F.lit(0.0))
                  .otherwise(F.col("_same").cast("double") / n))
    return s.select(
        key, "n_tests", "gt_lines", "gen_lines",
        gs.alias("gt_score"), es.alias("gen_score"),
        run_status(F.col("gt_lines"), gs).alias("gt_status"),
        run_status(F.col("gen_lines"), es).alias("gen_status"),
        agreement.alias("agreement"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (n - tp - fp - fn).alias("tn"),
    )


def outcome_matrix(compared: DataFrame) -> DataFrame:
    """Gt status x gen status with count, squared-error sum and
    agreement sum.  All nine cells are present (empty cells have count 0):
    the fixed 3x3 skeleton is the preserved side of an outer join with the
    at-most-nine aggregated rows.  Cell members are :func:`outcome_members`."""
    cells = compared.groupBy("gt_status", "gen_status").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum((F.col("gt_score") - F.col("gen_score")) ** 2).alias("se"),
        F.sum("agreement").alias("agree"))
    spark = compared.sparkSession
    grid = spark.createDataFrame([(g, e) for g in range(3) for e in range(3)],
                                 "gt_status int, gen_status int")
    out = F.broadcast(grid).join(cells, ["gt_status", "gen_status"], "left")
    return out.select("gt_status", "gen_status",
                      F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"),
                      F.coalesce("se", F.lit(0.0)).alias("se"),
                      F.coalesce("agree", F.lit(0.0)).alias("agree"))


def outcome_members(compared: DataFrame, key: str = KEY) -> DataFrame:
    """A9 member lists as a flat table (cell, submission, squared error,
    agreement): a cell can hold every submission, so it is never gathered
    into one array."""
    return compared.select("gt_status", "gen_status", key,
                           ((F.col("gt_score") - F.col("gen_score")) ** 2).alias("se"),
                           "agreement")


def comparison_report(compared: DataFrame, generated: DataFrame | None = None, code: str = "code",
                      expected: str = "expected") -> DataFrame:
    """G6 (+ A10, M1, M2 over tests): one row.

    n, mean gt/gen score, MSE between them, mean agreement, the four
    output quadrants (both / gt only / gen only / neither produced output),
    F1 and accuracy of gen's per-test pass/fail against gt's.  With the
    ``generated`` programs also their counters (:func:`extraction_counters`);
    both reports are aggregates of their own, stacked and folded to one row.
    """
    gl, el = F.col("gt_lines") > 0, F.col("gen_lines") > 0
    tp, fp, fn, tn = (F.sum(c) for c in ("tp", "fp", "fn", "tn"))
    report = compared.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("gt_score").alias("gt_mean"),
        F.avg("gen_score").alias("gen_mean"),
        F.avg((F.col("gt_score") - F.col("gen_score")) ** 2).alias("mse"),
        F.avg("agreement").alias("agreement"),
        F.count_if(gl & el).alias("both_output"),
        F.count_if(gl & ~el).alias("gt_only_output"),
        F.count_if(~gl & el).alias("gen_only_output"),
        F.count_if(~gl & ~el).alias("no_output"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.try_divide((tp + tn).cast("double"), tp + tn + fp + fn).alias("accuracy"),
    )
    if generated is None:
        return report
    both = report.unionByName(extraction_counters(generated, code, expected), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def quadrant_report(compared: DataFrame) -> DataFrame:
    """A10: per output quadrant, count, squared-error sum and agreement sum."""
    return compared.groupBy(
        (F.col("gt_lines") > 0).alias("gt_has_output"),
        (F.col("gen_lines") > 0).alias("gen_has_output"),
    ).agg(F.count(F.lit(1)).alias("cnt"),
          F.sum((F.col("gt_score") - F.col("gen_score")) ** 2).alias("se"),
          F.sum("agreement").alias("agree"))


def failed_runs(compared: DataFrame, key: str = KEY) -> DataFrame:
    """Submissions whose generated run had no output, flagged when the
    ground truth passed every test."""
    return compared.where(F.col("gen_status") == 0).select(
        key, "gt_status", (F.col("gt_status") == 2).alias("gt_all_pass"))


def error_report(errors: DataFrame, key: str = KEY,
                 marker: str = "cannot be applied to given types;") -> DataFrame:
    """Errors (key, kind, message) -> one row of counts.

    Failed runs by kind (a run counts once, whatever its number of messages),
    errors in total and per failed run, the ``marker`` message counted per
    error and once per run, and the errors without it.  All means are NULL
    where nothing failed.
    """
    m = F.col("message").contains(marker)
    runs = errors.groupBy(key).agg(
        F.max((F.col("kind") == "compile").cast("int")).alias("_compile"),
        F.max((F.col("kind") == "run").cast("int")).alias("_run"),
        F.count(F.lit(1)).alias("_n"), F.count_if(m).alias("_marked"))
    n, marked, failed = F.sum("_n"), F.sum("_marked"), F.count(F.lit(1))
    none = F.lit(0).cast("long")
    return runs.agg(
        F.coalesce(F.sum("_compile"), none).alias("compile_errors"),
        F.coalesce(F.sum("_run"), none).alias("run_errors"),
        F.coalesce(n, none).alias("total_errors"),
        failed.alias("failed_runs"),
        F.try_divide(n, failed).alias("errors_per_failed_run"),
        F.coalesce(marked, none).alias("marker_errors"),
        F.count_if(F.col("_marked") > 0).alias("marker_runs"),
        F.coalesce(n - marked, none).alias("other_errors"),
        F.try_divide(n - marked, failed).alias("other_errors_per_failed_run"),
    )


def error_histogram(errors: DataFrame) -> DataFrame:
    """Counter of error messages."""
    return errors.groupBy("message").agg(F.count(F.lit(1)).alias("cnt"))


def extraction_counters(generated: DataFrame, code: str = "code", expected: str = "expected") -> DataFrame:
    """One row over generated programs.

    Edge cases have no name or no type of the main method; a name that
    differs from the expected one, or is missing, is a mismatch; valid ones
    are no edge case and have a closing brace."""
    f = generated.select(code, expected, main_function(code, expected).alias("_f"))
    edge = F.col("_f.name").isNull() | F.col("_f.type").isNull()
    return f.agg(F.count_if(edge).alias("edge_cases"),
                 F.count_if(~F.col("_f.name").eqNullSafe(F.col(expected))).alias("name_mismatch"),
                 F.count_if(~edge & F.col(code).contains("}")).alias("valid"),
                 F.count(F.lit(1)).alias("total"))
