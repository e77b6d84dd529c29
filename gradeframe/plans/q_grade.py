"""Registered grading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.operators import grade as G
from gradeframe.plans import adapters as A
from gradeframe.plans import sqlbase as Q
from gradeframe.plans.catalog import r6, register


def _compared(spark, d):
    return G.compare_texts(A.run_texts(spark, d))


@register("G5_outcome_matrix", f"""WITH {Q.RUNS}
SELECT gs AS gt_status, es AS gen_status, count(*) AS cnt,
  round(sum((ga-ea)*(ga-ea)),6) AS se, round(sum(agree),6) AS agree FROM t GROUP BY gs, es""")
def g5(spark, d):
    m = G.outcome_matrix(_compared(spark, d))
    return m.where(F.col("cnt") > 0).select("gt_status", "gen_status", "cnt",
                                            r6("se").alias("se"), r6("agree").alias("agree"))


@register("G6_comparison_report", f"""WITH {Q.RUNS}
SELECT count(*) AS n, round(avg(ga),6) AS gt_mean, round(avg(ea),6) AS gen_mean,
  round(avg((ga-ea)*(ga-ea)),6) AS mse, round(avg(agree),6) AS agreement,
  count(*) FILTER (WHERE gm>0 AND em>0) AS both_output,
  count(*) FILTER (WHERE gm>0 AND em=0) AS gt_only_output,
  count(*) FILTER (WHERE gm=0 AND em>0) AS gen_only_output,
  count(*) FILTER (WHERE gm=0 AND em=0) AS no_output,
  round(coalesce(2.0*sum(tp)/nullif(2*sum(tp)+sum(fp)+sum(fn),0),0),6)::DOUBLE AS f1,
  round(CAST(sum(tp)+sum(tn) AS DOUBLE)/(sum(tp)+sum(tn)+sum(fp)+sum(fn)),6) AS accuracy
FROM t""")
def g6(spark, d):
    r = G.comparison_report(_compared(spark, d))
    return r.select("n", r6("gt_mean").alias("gt_mean"), r6("gen_mean").alias("gen_mean"),
                    r6("mse").alias("mse"), r6("agreement").alias("agreement"),
                    "both_output", "gt_only_output", "gen_only_output", "no_output",
                    r6("f1").alias("f1"), r6("accuracy").alias("accuracy"))


@register("G1_grade_summary", f"""WITH {Q.RUNS}
SELECT submission_id, n AS n_tests, gm AS n_lines, round(ga,6) AS score,
  CASE WHEN gm=0 THEN 0 WHEN ga=1 THEN 2 ELSE 1 END AS status FROM t""")
def g1(spark, d):
    s = G.grade_summary_texts(A.run_texts(spark, d), run="gt")
    return s.select("submission_id", "n_tests", "n_lines", r6("score").alias("score"), "status")


@register("G2_grade_tests", f"""WITH {Q.RUNS}
SELECT submission_id, test_no, ge AS hit, gp AS passed FROM g""")
def g2(spark, d):
    return G.grade_tests_texts(A.run_texts(spark, d), run="gt", with_texts=False) \
        .select("submission_id", "test_no", "hit", "passed")


@register("G3_agreement", f"""WITH {Q.RUNS}
SELECT submission_id, round(agree,6) AS agreement FROM t""")
def g3(spark, d):
    return _compared(spark, d).select("submission_id", r6("agreement").alias("agreement"))


@register("G4_run_status", f"""WITH {Q.RUNS}
SELECT gs AS status, count(*) AS cnt FROM t GROUP BY gs""")
def g4(spark, d):
    return (_compared(spark, d).groupBy(F.col("gt_status").alias("status"))
            .agg(F.count(F.lit(1)).alias("cnt")))


@register("A10_output_quadrants", f"""WITH {Q.RUNS}
SELECT gm>0 AS gt_has_output, em>0 AS gen_has_output, count(*) AS cnt,
  round(sum((ga-ea)*(ga-ea)),6) AS se, round(sum(agree),6) AS agree FROM t GROUP BY 1, 2""")
def a10(spark, d):
    q = G.quadrant_report(_compared(spark, d))
    return q.select("gt_has_output", "gen_has_output", "cnt", r6("se").alias("se"),
                    r6("agree").alias("agree"))


@register("G8_failed_runs", f"""WITH {Q.RUNS}
SELECT submission_id, gs AS gt_status, gs=2 AS gt_all_pass FROM t WHERE es=0""")
def g8(spark, d):
    return G.failed_runs(_compared(spark, d))


@register("A9_outcome_members", f"""WITH {Q.RUNS}
SELECT gs AS gt_status, es AS gen_status, submission_id, round((ga-ea)*(ga-ea), 6) AS se,
  round(agree, 6) AS agreement FROM t""")
def a9(spark, d):
    m = G.outcome_members(_compared(spark, d))
    return m.select("gt_status", "gen_status", "submission_id", r6("se").alias("se"),
                    r6("agreement").alias("agreement"))


@register("J7_aligned_texts", f"""WITH {Q.RUNS}
SELECT g.submission_id, g.test_no, g.expected, gt.line, ge AS hit, gp AS passed, g.n AS n_tests, gm AS n_lines
FROM (SELECT g.*, k.expected FROM g JOIN k USING (submission_id, test_no)) g
LEFT JOIN gt ON g.submission_id = gt.submission_id AND g.test_no = gt.line_no""")
def j7(spark, d):
    """Expected outputs beside the lines printed at their positions."""
    return G.grade_tests_texts(A.run_texts(spark, d), run="gt").select(
        "submission_id", "test_no", "expected", "line", "hit", "passed", "n_tests", "n_lines")
