"""Registered queries against their DuckDB oracle SQL on the smallest
tables: one representative per operator family (the full set runs with
tools/check_oracle.py)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import digest, type_diffs  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["G5_outcome_matrix", "G6_comparison_report", "M4_roc_auc", "M6_pass_rate_mse",
         "W1_segment_records", "W5_to_sequences", "W9_prefix_metrics", "J3_merge_all_submissions",
         "B1_corpus_bleu", "B4_smoothed_pair_bleu", "B10_weighted_recall_bleu", "B5_distinct_n",
         "B6_syntax_match", "B7_dataflow_match", "X15_strip_comments", "X17_nist_normalize",
         "V1_mean_vector", "V3_head_logits", "S2_read_cases_skip", "S6_flatten_nested",
         "A6_element_log", "T6_problem_index", "A12_multi_reference_bleu", "B2_multi_reference", "B3_multi_reference",
         "B4_average_reference", "B4_closest_reference", "B10_multi_reference", "B12_sentence_method0",
         "B12_sentence_method5", "B12_sentence_method6", "B12_sentence_method7", "J7_aligned_texts", "G6_full_report",
         "X5_first_declaration", "X6_among_methods", "X8_harness_types", "X9_output_texts", "X10_run_outputs",
         "P10_repeated_words", "P4_label_kinds", "B8_shared_positions"]


@pytest.fixture(scope="module")
def con():
    from gradeframe.plans.adapters import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    from gradeframe.plans import catalog
    df = catalog.QUERIES[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(catalog.ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
    stypes = [f.dataType.simpleString() for f in df.schema.fields]
    assert type_diffs(df.columns, stypes, dcols, [str(d[1]) for d in cur.description]) == []


TURN_NAMES = ["X16_turn_tokens", "X17_turn_nist_normalize", "X18_turn_split_puncts", "X19_turn_ngrams",
              "B5_turn_distinct_n", "B5_turn_distinct_n_punct"]


@pytest.mark.parametrize("name", TURN_NAMES)
def test_one_text_queries_read_all_turns(spark, con, name):
    from gradeframe.plans import catalog
    test_query_matches_oracle(spark, con, name)
    turns, rows = (con.execute(q).fetchone()[0] for q in (
        "SELECT count(*) FROM conversations", f"SELECT count(*) FROM ({catalog.ORACLE[name]})"))
    if name[:3] in ("X16", "X17", "X18"):
        assert rows == turns


def test_new_rows_meet_the_hard_cases(con):
    """The rows added for a branch hold rows on both sides of it."""
    from gradeframe.plans import catalog

    def ask(name, what):
        return con.execute(f"SELECT {what} FROM ({catalog.ORACLE[name]})").fetchone()
    for name in ("P10_repeated_words", "X10_run_outputs"):
        column = catalog.ORACLE[name].split(" AS ")[-1].split(" FROM ")[0]
        yes, rows = ask(name, f"count(*) FILTER ({column}), count(*)")
        assert 0 < yes < rows
    assert ask("X6_among_methods", "count(DISTINCT type)")[0] == 4
    assert 0 < ask("X6_among_methods", "count(name)")[0] < ask("X6_among_methods", "count(*)")[0]
    assert ask("B8_shared_positions", "count(*) FILTER (contains(parents, ','))")[0] > 0
    assert 0 < ask("J7_aligned_texts", "count(line)")[0] < ask("J7_aligned_texts", "count(*)")[0]
    one, several = ask("A12_multi_reference_bleu", "ref_len, hyp_len"), ask("B1_corpus_bleu", "ref_len, hyp_len")
    assert one[1] == several[1] and one[0] != several[0]
