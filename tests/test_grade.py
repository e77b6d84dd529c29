"""Grading (G1-G8, X9, X10) against the worked cases and the flagship."""

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import grade as G


def _cases(spark, expected):
    return spark.createDataFrame([(1, i + 1, e) for i, e in enumerate(expected)],
                                 "submission_id long, test_no long, expected string")


def _lines(spark, out, run="gt"):
    return spark.createDataFrame([(1, run, i + 1, v) for i, v in enumerate(out)],
                                 "submission_id long, run string, line_no long, line string")


@pytest.mark.parametrize("out,score,passed", [
    ([], 0.0, [0, 0, 0, 0]),
    (["1", "9", "3", "4"], 0.75, [1, 0, 1, 1]),
    (["1", "2", "3", "4", "5"], 1.0, [1, 1, 1, 1]),
    (["1", "2", "3", "4", "1", "2", "3", "4"], 0.0, [0, 0, 0, 0]),
    (["1", "2"], 0.5, [1, 1, 0, 0]),          # D10: missing line = fail
])
def test_grade_one_run(spark, out, score, passed):
    cases = _cases(spark, ["1", "2", "3", "4"])
    lines = _lines(spark, out)
    s = G.grade_summary(cases, lines).collect()[0]
    assert s.score == pytest.approx(score)
    t = G.grade_tests(cases, lines).orderBy("test_no").collect()
    assert [r.passed for r in t] == passed


def test_agreement(spark):
    cases = _cases(spark, ["1", "2", "3", "4"])
    gt = _lines(spark, ["1", "2", "x", "4"], "gt")
    gen = _lines(spark, ["1", "x", "x", "4"], "gen")
    c = G.compare_runs(cases, gt.unionByName(gen)).collect()[0]
    assert c.agreement == pytest.approx(0.75)
    none = G.compare_runs(cases, gt.limit(0)).collect()[0]
    assert none.agreement == 1.0 and none.gt_status == 0 and none.gen_status == 0
    one = G.compare_runs(cases, gt).collect()[0]
    assert one.agreement == 0.0


def test_output_to_lines(spark):
    raw = spark.createDataFrame([(1, "gt", "1\n2\n"), (2, "gt", "compilation failed: x\n"),
                                 (3, "gt", "Timeout"), (4, "gt", "")],
                                "submission_id long, run string, output string")
    rows = G.output_to_lines(raw).orderBy("submission_id", "line_no").collect()
    assert [(r.submission_id, r.line_no, r.line) for r in rows] == [(1, 1, "1"), (1, 2, "2")]


def test_error_report(spark):
    e = spark.createDataFrame([
        (1, "compile", "cannot find symbol"), (1, "compile", "method f cannot be applied to given types;"),
        (2, "run", "Exception"), (3, "compile", "x cannot be applied to given types;"),
        (3, "compile", "y cannot be applied to given types;")],
        "submission_id long, kind string, message string")
    r = G.error_report(e).collect()[0]
    assert (r.compile_errors, r.run_errors, r.total_errors, r.failed_runs) == (2, 1, 5, 3)
    assert r.marker_errors == 3 and r.marker_runs == 2
    assert r.errors_per_failed_run == pytest.approx(5 / 3)
    assert r.other_errors == 2 and r.other_errors_per_failed_run == pytest.approx(2 / 3)
    none = G.error_report(e.limit(0)).collect()[0]
    assert (none.total_errors, none.failed_runs, none.errors_per_failed_run) == (0, 0, None)


def test_flagship_matrix_matches_fixture(spark):
    from gradeframe.plans import catalog
    m = {(r.gt_status, r.gen_status): (r.cnt, r.se, r.agree)
         for r in catalog.QUERIES["G5_outcome_matrix"](spark, "/root/testdata/sf0.01").collect()}
    expected = {(0, 0): (420, 0.0, 420.0), (0, 1): (1487, 362.828133, 0.0),
                (0, 2): (200, 200.0, 0.0), (1, 0): (2291, 496.204678, 0.0),
                (1, 1): (8161, 833.78669, 4397.430089), (1, 2): (890, 515.817564, 300.089286),
                (2, 0): (238, 238.0, 0.0), (2, 1): (752, 408.89173, 236.210714),
                (2, 2): (304, 0.0, 304.0)}
    assert m == expected
    assert sum(v[0] for v in m.values()) == 14743
    g6 = catalog.QUERIES["G6_comparison_report"](spark, "/root/testdata/sf0.01").collect()[0]
    assert (g6.n, g6.gt_mean, g6.gen_mean, g6.mse, g6.agreement) == \
        (14743, 0.382965, 0.396969, 0.207253, 0.383757)


def test_null_expected_still_counts_as_a_test(spark):
    cases = spark.createDataFrame([(1, 1, "1"), (1, 2, None)],
                                  "submission_id long, test_no long, expected string")
    lines = _lines(spark, ["1", "x"])
    s = G.grade_summary(cases, lines).collect()[0]
    assert (s.n_tests, s.hits, s.score) == (2, 1, 0.5)


def test_grade_tests_without_texts_agrees(spark):
    cases = _cases(spark, ["1", "2", "3", "4"])
    lines = _lines(spark, ["1", "9", "3"])
    t = G.texts_from(cases, lines)
    a = {(r.test_no, r.hit, r.passed) for r in G.grade_tests_texts(t, with_texts=True).collect()}
    b = {(r.test_no, r.hit, r.passed) for r in G.grade_tests_texts(t, with_texts=False).collect()}
    assert a == b == {(1, 1, 1), (2, 0, 0), (3, 1, 1), (4, 0, 0)}


def test_extraction_counters(spark):
    rows = [("public int f(int x) { return x; }", "f"), ("public boolean isSix", "isSix"), ("public int g(int x) {", "g"),
            ("public int h(int x) { }", "f"), ("public int a(int x) { }\npublic int f(int y) { }", "f"), ("int x = 1;", "f")]
    c = G.extraction_counters(spark.createDataFrame(rows, "code string, expected string")).collect()[0]
    assert (c.edge_cases, c.name_mismatch, c.valid, c.total) == (2, 3, 3, 6)


def test_report_with_the_programs_counters(spark):
    cases, lines = _cases(spark, ["1", "2"]), _lines(spark, ["1", "x"])
    compared = G.compare_runs(cases, lines.unionByName(_lines(spark, ["1", "2"], "gen")))
    programs = spark.createDataFrame([("public int f(int a) {\n}", "f"), ("public int g(int a) {\n", "f"), ("x = 1;", "f"),
                                      ("", None)], "code string, expected string")
    plain, full = G.comparison_report(compared), G.comparison_report(compared, programs)
    r = full.collect()[0].asDict()
    assert {c: r[c] for c in plain.columns} == plain.collect()[0].asDict()
    assert (r["edge_cases"], r["name_mismatch"], r["valid"], r["total"]) == (2, 2, 1, 4)
    none = G.comparison_report(compared.limit(0), programs.limit(0)).collect()
    assert len(none) == 1 and none[0]["n"] == 0 and none[0]["total"] == 0 and none[0]["mse"] is None
