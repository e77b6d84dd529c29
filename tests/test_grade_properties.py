"""Property test: grading equals a plain-Python statement of the rules on
random batches of submissions."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gradeframe.operators import grade as G

VALS = st.sampled_from(["0", "1", "true", "false"])
SUB = st.tuples(st.lists(VALS, min_size=1, max_size=6),            # expected per test
                st.one_of(st.just([]), st.lists(VALS, max_size=14)),  # gt lines
                st.one_of(st.just([]), st.lists(VALS, max_size=14)))  # gen lines


def py_score(expected, out):
    n = len(expected)
    if len(out) == 0 or len(out) >= 2 * n:
        return 0.0, [0] * n
    hits = [1 if i < len(out) and out[i] == e else 0 for i, e in enumerate(expected)]
    return sum(hits) / n, hits


def py_status(out, score):
    return 0 if len(out) == 0 else (2 if score == 1 else 1)


def py_agree(expected, gt, gen):
    if not gt and not gen:
        return 1.0
    if not gt or not gen:
        return 0.0
    hg = [1 if i < len(gt) and gt[i] == e else 0 for i, e in enumerate(expected)]
    he = [1 if i < len(gen) and gen[i] == e else 0 for i, e in enumerate(expected)]
    return sum(1 for a, b in zip(hg, he) if a == b) / len(expected)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(SUB, min_size=1, max_size=12))
def test_compare_runs_matches_rules(spark, subs):
    cases, lines = [], []
    for sid, (exp, gt, gen) in enumerate(subs, start=1):
        cases += [(sid, t + 1, e) for t, e in enumerate(exp)]
        lines += [(sid, "gt", i + 1, v) for i, v in enumerate(gt)]
        lines += [(sid, "gen", i + 1, v) for i, v in enumerate(gen)]
    c = spark.createDataFrame(cases, "submission_id long, test_no long, expected string")
    ln = spark.createDataFrame(lines, "submission_id long, run string, line_no long, line string")
    got = {r.submission_id: r for r in G.compare_runs(c, ln).collect()}
    for sid, (exp, gt, gen) in enumerate(subs, start=1):
        r = got[sid]
        gs, gp = py_score(exp, gt)
        es, ep = py_score(exp, gen)
        assert abs(r.gt_score - gs) < 1e-12 and abs(r.gen_score - es) < 1e-12
        assert r.gt_status == py_status(gt, gs) and r.gen_status == py_status(gen, es)
        assert abs(r.agreement - py_agree(exp, gt, gen)) < 1e-12
        tp = sum(a & b for a, b in zip(gp, ep))
        fp = sum((1 - a) & b for a, b in zip(gp, ep))
        fn = sum(a & (1 - b) for a, b in zip(gp, ep))
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, len(exp) - tp - fp - fn)
