"""Registered curation and sequence queries (P, J, W, T, A1-A4, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.operators import curate as C
from gradeframe.operators import sequence as S
from gradeframe.plans import adapters as A
from gradeframe.plans import sqlbase as Q
from gradeframe.plans.catalog import r6, register

ORDER = ["server_ts", "code_state_id"]
MAX_LEN = 20

SEG = f"""seg AS (SELECT *, CAST((row_number() OVER (PARTITION BY subject_id
   ORDER BY server_ts, code_state_id) - 1) % {MAX_LEN} AS INTEGER) AS timestep,
  CAST((row_number() OVER (PARTITION BY subject_id ORDER BY server_ts, code_state_id) - 1)
   // {MAX_LEN} + 1 AS INTEGER) AS segment FROM subs),
seq AS (SELECT *, CAST(subject_id AS VARCHAR) || '_' || CAST(segment AS VARCHAR) AS seq_id FROM seg)"""


def _segments(spark, d):
    return S.segment_records(A.submissions(spark, d), "subject_id", ORDER, MAX_LEN)


@register("W1_segment_records", f"""WITH {Q.SUBS}, {SEG}
SELECT subject_id, code_state_id, timestep, segment, seq_id FROM seq""")
def w1(spark, d):
    return _segments(spark, d).select("subject_id", "code_state_id", "timestep", "segment", "seq_id")


@register("W2_first_submission", f"""WITH {Q.SUBS}
SELECT subject_id, problem_id, code_state_id, server_ts, score FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id, problem_id
    ORDER BY server_ts, code_state_id) rn FROM subs) WHERE rn = 1""")
def w2(spark, d):
    f = S.first_submission(A.submissions(spark, d), "subject_id", "problem_id", ORDER)
    return f.select("subject_id", "problem_id", "code_state_id", "server_ts", "score")


@register("W3_dedupe_first", f"""WITH {Q.SUBS}
SELECT subject_id, day, code_state_id, problem_id FROM (
  SELECT *, CAST(server_ts AS DATE) AS day, row_number() OVER (PARTITION BY subject_id,
    CAST(server_ts AS DATE) ORDER BY score DESC, code_state_id) rn FROM subs) WHERE rn = 1""")
def w3(spark, d):
    s = A.submissions(spark, d).withColumn("day", F.to_date("server_ts")) \
        .withColumn("_neg", -F.col("score"))
    f = S.dedupe_first(s, ["subject_id", "day"], ["_neg", "code_state_id"])
    return f.select("subject_id", "day", "code_state_id", "problem_id")


@register("W4_next_step", f"""WITH {Q.SUBS}, {SEG}
SELECT seq_id, timestep, problem_id, lead(problem_id) OVER w AS next_problem_id,
  lead(score) OVER w AS next_score FROM seq WINDOW w AS (PARTITION BY seq_id ORDER BY timestep)""")
def w4(spark, d):
    n = S.next_step(_segments(spark, d), "seq_id", "timestep", ["problem_id", "score"])
    return n.select("seq_id", "timestep", "problem_id", "next_problem_id", "next_score")


@register("W5_to_sequences", f"""WITH {Q.SUBS}, {SEG}
SELECT seq_id, count(*) AS length, string_agg(problem_id, ',' ORDER BY timestep) AS problems,
  round(sum(score),6) AS score_sum FROM seq GROUP BY seq_id""")
def w5(spark, d):
    s = S.to_sequences(_segments(spark, d), "seq_id", "timestep", ["problem_id", "score"])
    return s.select("seq_id", F.col("length").cast("long").alias("length"),
                    F.array_join("problem_id", ",").alias("problems"),
                    r6(F.aggregate("score", F.lit(0.0), lambda a, x: a + x)).alias("score_sum"))


@register("W6_pad_sequences", f"""WITH {Q.SUBS}, {SEG},
l AS (SELECT seq_id, list(CASE WHEN score >= 250 THEN 1 ELSE 0 END ORDER BY timestep) AS lab
  FROM seq GROUP BY seq_id)
SELECT seq_id, array_to_string(list_concat(lab, list_transform(
  range({MAX_LEN} - len(lab)), lambda x: -100)), ',') AS labels_padded FROM l""")
def w6(spark, d):
    seg = _segments(spark, d).withColumn("lab", F.when(F.col("score") >= 250, 1).otherwise(0))
    s = S.to_sequences(seg, "seq_id", "timestep", ["lab"])
    p = S.pad_sequences(s, {"lab": -100}, length=MAX_LEN)
    return p.select("seq_id", F.array_join("lab", ",").alias("labels_padded"))


@register("W7_assign_batches", f"""WITH {Q.SUBS}
SELECT code_state_id, CAST((row_number() OVER (ORDER BY subject_id, server_ts, code_state_id) - 1)
  // 64 AS BIGINT) AS batch FROM subs""")
def w7(spark, d):
    b = S.assign_batches(A.submissions(spark, d), ["subject_id", "server_ts", "code_state_id"], 64)
    return b.select("code_state_id", "batch")


@register("P6_drop_cold_start", f"""WITH {Q.SUBS}, {SEG}
SELECT seq_id, timestep, code_state_id FROM seq WHERE timestep > 0""")
def p6(spark, d):
    return C.drop_cold_start(_segments(spark, d)).select("seq_id", "timestep", "code_state_id")


@register("W10_state_at", f"""WITH {Q.SUBS}, {SEG},
req AS (SELECT seq_id, timestep - 1 AS step FROM seq WHERE timestep > 0 AND problem_id = 'error')
SELECT req.seq_id, req.step, s.code_state_id AS state_code_state_id FROM req
LEFT JOIN seq s ON s.seq_id = req.seq_id AND s.timestep = req.step""")
def w10(spark, d):
    seg = _segments(spark, d)
    req = (seg.where((F.col("timestep") > 0) & (F.col("problem_id") == "error"))
              .select("seq_id", (F.col("timestep") - 1).alias("step")))
    states = seg.select("seq_id", F.col("timestep").alias("step"),
                        F.col("code_state_id").alias("state_code_state_id"))
    return S.state_at(states, req, ["seq_id", "step"])


@register("P7_as_next_step", f"""WITH {Q.SUBS}, {SEG}
SELECT seq_id, timestep, score AS next_Score, problem_id AS next_prompt FROM seq WHERE timestep > 0""")
def p7(spark, d):
    s = C.drop_cold_start(_segments(spark, d)).select(
        "seq_id", "timestep", F.col("score").alias("Score"), F.col("problem_id").alias("prompt"))
    return C.as_next_step(s)


@register("P4_label_format", f"""WITH {Q.SUBS}
SELECT code_state_id, CASE WHEN CAST(floor(score / 125) AS INTEGER) >= 2 THEN 1 ELSE 0 END AS Score
FROM subs""")
def p4(spark, d):
    s = A.submissions(spark, d).select(
        "code_state_id", (F.col("score") / 500).alias("Score_x"),
        F.floor(F.col("score") / 125).cast("int").alias("Score_y"))
    return C.apply_label_format(s, "binary")


@register("P4_label_kinds", f"""WITH {Q.SUBS}
SELECT code_state_id, CAST(floor(score / 125) AS INTEGER) AS ternary, round(score / 500, 6) AS raw FROM subs""")
def p4_kinds(spark, d):
    """P4's other kinds: the class itself and the raw score."""
    s = A.submissions(spark, d).select(
        "code_state_id", (F.col("score") / 500).alias("Score_x"), F.floor(F.col("score") / 125).cast("int").alias("Score_y"),
        (F.col("score") / 500).alias("kept"))
    t = C.apply_label_format(s, "ternary", out="ternary").withColumns({"Score_x": F.col("kept"), "Score_y": F.col("ternary")})
    return C.apply_label_format(t, "raw", out="raw").select("code_state_id", "ternary", r6("raw").alias("raw"))


@register("P2_filter_events", """SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'""")
def p2(spark, d):
    return C.filter_events(A.load(spark, d, "events"), "purchase", "event_type") \
        .select("event_id", "user_id", "ts")


@register("P1_select_core", """SELECT * EXCLUDE (props, value) FROM events""")
def p1(spark, d):
    return C.select_core(A.load(spark, d, "events"), ["props", "value"])


@register("J1_attach_event_time", f"""WITH {Q.SUBS},
ev AS (SELECT user_id, event_type, event_id, ts FROM events WHERE event_type = 'click')
SELECT s.subject_id, s.problem_id, s.code_state_id, ev.ts AS run_ts FROM subs s
LEFT JOIN ev ON s.subject_id = ev.user_id AND s.problem_id = ev.event_type
  AND s.code_state_id = ev.event_id""")
def j1(spark, d):
    subs = A.submissions(spark, d).select("subject_id", "problem_id", "code_state_id")
    ev = C.filter_events(A.load(spark, d, "events"), "click", "event_type").select(
        F.col("user_id").alias("subject_id"), F.col("event_type").alias("problem_id"),
        F.col("event_id").alias("code_state_id"), F.col("ts").alias("run_ts"))
    return C.attach_event_time(subs, ev, ["subject_id", "problem_id", "code_state_id"], ["run_ts"])


@register("J2_attach_labels", """SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d
LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j2(spark, d):
    docs = A.load(spark, d, "documents").select("doc_id", "lang")
    return C.attach_labels(docs, A.load(spark, d, "labels"), ["doc_id"])


@register("J3_merge_all_submissions", f"""WITH {Q.SUBS}, {SEG},
r AS (SELECT subject_id, code_state_id, score, props AS extra FROM subs WHERE score > 100),
j AS (SELECT r.subject_id, r.code_state_id, r.score, seq.timestep, r.extra FROM seq
  RIGHT JOIN r ON seq.subject_id = r.subject_id AND seq.code_state_id = r.code_state_id
  AND seq.score = r.score)
SELECT subject_id, code_state_id, timestep, score FROM (SELECT *, row_number() OVER
  (PARTITION BY subject_id, code_state_id, timestep ORDER BY score) rn FROM j) WHERE rn = 1""")
def j3(spark, d):
    seg = _segments(spark, d).select("subject_id", "code_state_id", "score", "timestep")
    r = A.submissions(spark, d).where(F.col("score") > 100).select(
        "subject_id", "code_state_id", "score", F.col("props").alias("extra"))
    m = C.merge_all_submissions(seg, r, ["subject_id", "code_state_id", "score"],
                                ["subject_id", "code_state_id", "timestep"], ["score"])
    return m.select("subject_id", "code_state_id", "timestep", "score")


@register("J3_within_tolerance", """WITH l AS (SELECT o_custkey, o_orderkey AS l_key,
  CASE WHEN o_orderkey % 17 <> 0 THEN floor(o_totalprice / 1000) END AS score FROM orders),
r AS (SELECT o_custkey, o_orderkey AS r_key, CASE WHEN o_orderkey % 19 <> 0 THEN floor(o_totalprice / 1000)
  + CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 0.75 WHEN 4 THEN -0.5 ELSE 1.5 END END AS score
  FROM orders)
SELECT r.o_custkey, l_key, r_key, l.score AS score_left, r.score FROM l RIGHT JOIN r ON l.o_custkey = r.o_custkey
  AND (abs(l.score - r.score) <= 0.5 OR (l.score IS NULL AND r.score IS NULL))""")
def j3_within(spark, d):
    """J3 with a tolerance of 0.5: scores apart by less, by just as much (at
    bucket borders) and by more, and null ones."""
    o = A.load(spark, d, "orders")
    base, k = F.floor(F.col("o_totalprice") / 1000).cast("double"), F.col("o_orderkey")
    shift = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, -0.5, 1.5)]), (k % 6 + 1).cast("int"))
    left = o.select("o_custkey", k.alias("l_key"), F.when(k % 17 != 0, base).alias("score"))
    right = o.select("o_custkey", k.alias("r_key"), F.when(k % 19 != 0, base + shift).alias("score"))
    return C.join_within(left, right, ["o_custkey"], "score", 0.5).select("o_custkey", "l_key", "r_key", "score_left", "score")


@register("J4_lookup", f"""WITH {Q.SUBS},
p AS (SELECT problem_id, CAST(row_number() OVER (ORDER BY problem_id) - 1 AS BIGINT) AS problem_ix
  FROM (SELECT DISTINCT problem_id FROM subs))
SELECT s.code_state_id, p.problem_ix FROM subs s LEFT JOIN p ON s.problem_id = p.problem_id""")
def j4(spark, d):
    subs = A.submissions(spark, d)
    dim = S.problem_index(subs, "problem_id")
    return C.lookup(subs, dim, "problem_id").select("code_state_id", "problem_ix")


@register("T6_problem_index", f"""WITH {Q.SUBS}
SELECT problem_id, CAST(row_number() OVER (ORDER BY problem_id) - 1 AS BIGINT) AS problem_ix
FROM (SELECT DISTINCT problem_id FROM subs)""")
def t6(spark, d):
    return S.problem_index(A.submissions(spark, d), "problem_id")


@register("J5_keep_students", f"""WITH {Q.SUBS},
ids AS (SELECT DISTINCT user_id AS subject_id FROM events WHERE event_type = 'purchase' AND value > 200)
SELECT subject_id, code_state_id FROM subs WHERE subject_id IN (SELECT subject_id FROM ids)""")
def j5(spark, d):
    ev = A.load(spark, d, "events")
    ids = ev.where((F.col("event_type") == "purchase") & (F.col("value") > 200)) \
        .select(F.col("user_id").alias("subject_id"))
    return C.keep_members(A.submissions(spark, d), ids, "subject_id").select("subject_id", "code_state_id")


@register("J6_resolve_problem", """WITH dim AS (SELECT p_type, min(p_partkey) AS problem_id
  FROM part GROUP BY p_type)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, dim.problem_id FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey JOIN dim ON p.p_type = dim.p_type""")
def j6(spark, d):
    part = A.load(spark, d, "part")
    li = A.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    x = li.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    r = C.resolve_problem(x, part.select("p_type", F.col("p_partkey").alias("problem_id")),
                          "p_type", "problem_id")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "problem_id")


@register("A3_distinct_students", f"""WITH {Q.SUBS} SELECT DISTINCT subject_id FROM subs""")
def a3(spark, d):
    return C.distinct_values(A.submissions(spark, d), ["subject_id"])


@register("A4_count_distinct", f"""WITH {Q.SUBS}
SELECT count(DISTINCT subject_id) AS n_subject_id, count(DISTINCT problem_id) AS n_problem_id FROM subs""")
def a4(spark, d):
    return C.count_distinct(A.submissions(spark, d), ["subject_id", "problem_id"])


@register("U1_known_problem_ids", """SELECT DISTINCT p_partkey FROM (
  SELECT p_partkey FROM part
  UNION ALL SELECT unnest([29, 37, 106, 236, 239, 240])::BIGINT)""")
def u1(spark, d):
    ids = A.load(spark, d, "part")
    return C.with_known_ids(ids, "p_partkey")


@register("U2_concat_shards", """SELECT event_type, count(*) AS cnt FROM (
  SELECT event_type FROM events UNION ALL SELECT o_orderpriority FROM orders) GROUP BY 1""")
def u2(spark, d):
    ev = A.load(spark, d, "events").select("event_type")
    orders = A.load(spark, d, "orders").select(F.col("o_orderpriority").alias("event_type"))
    return C.concat_all([ev, orders]).groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))


@register("P5_score_match", """WITH t AS (SELECT l_orderkey, avg(CASE WHEN l_linestatus = 'O'
  THEN 1.0 ELSE 0.0 END)::DOUBLE AS test_mean FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'F' THEN 0.0 ELSE 0.5 END::DOUBLE
  AS score FROM orders)
SELECT coalesce(abs(test_mean - score) <= 1e-9, false) AS score_match, count(*) AS cnt
FROM s LEFT JOIN t ON s.o_orderkey = t.l_orderkey GROUP BY 1""")
def p5(spark, d):
    o = A.load(spark, d, "orders").select(
        F.col("o_orderkey").alias("submission_id"),
        F.when(F.col("o_orderstatus") == "O", 1.0).when(F.col("o_orderstatus") == "F", 0.0)
         .otherwise(0.5).alias("score"))
    t = A.load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("submission_id"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"))
    ok, bad = C.split_by_score_match(o, t)
    return ok.unionByName(bad).groupBy("score_match").agg(F.count(F.lit(1)).alias("cnt"))


@register("A1_cases_by_problem", """WITH k AS (SELECT l_orderkey, l_linestatus,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
   l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS test_no FROM lineitem)
SELECT l_orderkey AS submission_id, count(*) AS n_cases,
  string_agg(l_linestatus, '' ORDER BY test_no) AS expected FROM k GROUP BY 1""")
def a1(spark, d):
    cases, _ = A.cases_and_lines(spark, d)
    s = S.to_sequences(cases, "submission_id", "test_no", ["expected"])
    return s.select("submission_id", F.col("length").cast("long").alias("n_cases"),
                    F.array_join("expected", "").alias("expected"))


@register("A2_max_cases", """SELECT max(c) AS t_max FROM (SELECT count(*) c FROM lineitem GROUP BY l_orderkey)""")
def a2(spark, d):
    li = A.load(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("t_max"))


@register("T2_sort", f"""WITH {Q.SUBS}
SELECT subject_id, problem_id, code_state_id FROM subs ORDER BY subject_id, problem_id, code_state_id""")
def t2(spark, d):
    return A.submissions(spark, d).select("subject_id", "problem_id", "code_state_id") \
        .orderBy("subject_id", "problem_id", "code_state_id")


def unit_sql(seed: int, key: str) -> str:
    """The portable hash of one column in DuckDB."""
    return f"(CAST('0x' || substr(md5('{seed}|' || coalesce('=' || CAST({key} AS VARCHAR), '-')), 1, 13) AS BIGINT) / 4503599627370496)"


@register("T3_sample_n", f"""WITH {Q.SUBS}
SELECT * FROM subs ORDER BY {unit_sql(42, "code_state_id")}, code_state_id LIMIT 120""")
def t3(spark, d):
    return S.sample_n(A.submissions(spark, d), 120, 42, ["code_state_id"])


@register("T4_split_students", f"""WITH {Q.SUBS},
k AS (SELECT subject_id, row_number() OVER (ORDER BY {unit_sql(42, "subject_id")}, subject_id) AS r,
  count(*) OVER () AS n, CAST(ceil(count(*) OVER () * 0.2) AS BIGINT) AS m FROM (SELECT DISTINCT subject_id FROM subs)),
l AS (SELECT subject_id, CASE WHEN r <= n - m THEN 'train'
  WHEN r <= n - CAST(ceil(m / 2) AS BIGINT) THEN 'valid' ELSE 'test' END AS split FROM k)
SELECT split, count(DISTINCT l.subject_id) AS students, count(*) AS rows, CAST(sum(hash_part) AS BIGINT) AS ids
FROM l JOIN (SELECT subject_id, subject_id AS hash_part FROM subs) s ON s.subject_id IS NOT DISTINCT FROM l.subject_id
GROUP BY split""")
def t4(spark, d):
    s = S.split_exact(A.submissions(spark, d), ["subject_id"], 0.2, 42)
    return s.groupBy("split").agg(F.count_distinct("subject_id").alias("students"),
                                  F.count(F.lit(1)).alias("rows"), F.sum("subject_id").alias("ids"))


@register("T5_split_rows", f"""WITH {Q.SUBS}, u AS (SELECT code_state_id, {unit_sql(42, "code_state_id")} AS u FROM subs)
SELECT code_state_id, CASE WHEN u >= 0.2 THEN 'train' WHEN u < 0.1 THEN 'valid' ELSE 'test' END AS split FROM u""")
def t5(spark, d):
    s = S.split_by_hash(A.submissions(spark, d), ["code_state_id"], 0.2, 42)
    return s.select("code_state_id", "split")


@register("P3_valid_problems", """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'""")
def p3(spark, d):
    o = A.load(spark, d, "orders")
    return C.valid_problems(o, status="F", col="o_orderstatus").select("o_orderkey", "o_orderpriority")


@register("P9_non_empty", """SELECT count(*) FILTER (WHERE text IS NOT NULL AND length(text) > 0) AS non_empty,
  count(*) AS total FROM conversations""")
def p9(spark, d):
    c = A.load(spark, d, "conversations")
    return c.agg(F.count_if(C.non_empty("text")).alias("non_empty"), F.count(F.lit(1)).alias("total"))


@register("P11_clean_ids", """SELECT CAST(trunc(o_totalprice) AS BIGINT) AS price_id, count(*) AS cnt FROM orders
WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) GROUP BY 1""")
def p11(spark, d):
    o = A.load(spark, d, "orders")
    c = C.clean_ids(o, "o_totalprice", "price_id")
    return c.groupBy("price_id").agg(F.count(F.lit(1)).alias("cnt"))


@register("A1_prepare_cases", """WITH c AS (SELECT CAST(p_partkey // 26 AS BIGINT) AS problem_id, p_partkey AS test_no,
  p_name || '\\"' AS input, p_brand || '\\"' AS expected FROM part)
SELECT problem_id, count(*) AS n_cases,
  string_agg(CASE WHEN problem_id IN (34, 39, 40) THEN replace(rtrim(input, '"'), '\\', '"') ELSE input END,
    '|' ORDER BY test_no) AS inputs,
  string_agg(CASE WHEN problem_id IN (34, 40) THEN replace(rtrim(expected, '"'), '\\', '') ELSE expected END,
    '|' ORDER BY test_no) AS expected FROM c GROUP BY problem_id""")
def a1p(spark, d):
    p = A.load(spark, d, "part")
    # a problem holds at most T_max = 26 test cases: consecutive part keys
    c = p.select(F.floor(F.col("p_partkey") / 26).cast("long").alias("problem_id"),
                 F.col("p_partkey").alias("test_no"),
                 F.concat("p_name", F.lit('\\"')).alias("input"),
                 F.concat("p_brand", F.lit('\\"')).alias("expected"))
    s = C.cases_by_problem(C.prepare_cases(c))
    return s.select("problem_id", F.col("length").cast("long").alias("n_cases"),
                    F.array_join("input", "|").alias("inputs"),
                    F.array_join("expected", "|").alias("expected"))


@register("W7_time_major", f"""WITH {Q.SUBS}, {SEG},
sq AS (SELECT seq_id, CAST(min(subject_id) AS BIGINT) AS subject_id, min(segment) AS segment,
  list(problem_id ORDER BY timestep) AS problems FROM seq GROUP BY seq_id),
b AS (SELECT *, CAST((row_number() OVER (ORDER BY seq_id) - 1) // 8 AS BIGINT) AS batch FROM sq),
m AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY seq_id) - 1 AS k FROM b)
SELECT batch, CAST(k // 2 AS BIGINT) AS micro, CAST(t - 1 AS INTEGER) AS t, CAST(k % 2 AS INTEGER) AS member,
  problems[t] AS problems FROM m, unnest(range(1, len(problems) + 1)) u(t)""")
def w7t(spark, d):
    seqs = S.to_sequences(_segments(spark, d), "seq_id", "timestep", ["problem_id"])
    b = S.assign_batches(seqs, ["seq_id"], 8)
    return S.time_major(b, "batch", ["seq_id"], ["problem_id"]).withColumnRenamed("problem_id", "problems")


@register("W6_pad_to_longest", f"""WITH {Q.SUBS}, {SEG},
l AS (SELECT seq_id, list(CAST(round(score) AS BIGINT) ORDER BY timestep) AS s FROM seq GROUP BY seq_id),
m AS (SELECT max(len(s)) AS mx FROM l)
SELECT seq_id, array_to_string(list_concat(s, list_transform(range(mx - len(s)), lambda x: 0)), ',')
  AS scores_padded FROM l, m""")
def w6l(spark, d):
    seg = _segments(spark, d).withColumn("s", F.round("score").cast("long"))
    seqs = S.to_sequences(seg, "seq_id", "timestep", ["s"])
    p = S.pad_sequences(seqs, {"s": 0})          # length: longest sequence (scalar subquery)
    return p.select("seq_id", F.array_join("s", ",").alias("scores_padded"))


@register("W6_pad_steps", """WITH st AS (SELECT o_custkey, o_orderkey, any_value(o_orderstatus) AS status,
  list(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus) AS lab
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey),
sq AS (SELECT o_custkey, list(lab ORDER BY o_orderkey) AS labs, list(o_orderkey ORDER BY o_orderkey) AS keys,
  list(status ORDER BY o_orderkey) AS sts FROM st GROUP BY o_custkey),
m AS (SELECT max(len(labs)) AS steps, (SELECT max(len(lab)) FROM st) AS w FROM sq)
SELECT o_custkey, array_to_string(list_transform(list_concat(labs, list_transform(range(steps - len(labs)), lambda i: CAST([] AS INTEGER[]))),
    lambda x: array_to_string(list_concat(x, list_transform(range(w - len(x)), lambda i: -100)), ',')), ';') AS labels,
  array_to_string(list_concat(keys, list_transform(range(steps - len(keys)), lambda i: 0)), ',') AS problems,
  array_to_string(list_concat(sts, list_transform(range(steps - len(sts)), lambda i: '')), ',') AS codes FROM sq, m""")
def w6_steps(spark, d):
    """customers' orders as sequences, an order's lines as its tests."""
    li = A.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus",
                                             F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("lab"))
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "lab")))
    steps = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(lines["lab"].alias("labels"))
    o = A.load(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("codes"))
    seqs = S.to_sequences(o.join(steps, "o_orderkey").withColumn("problems", F.col("o_orderkey")),
                          "o_custkey", "o_orderkey", ["labels", "problems", "codes"])
    p = S.pad_steps(seqs, {"labels": -100}, {"problems": 0, "codes": ""})
    return p.select("o_custkey", F.array_join(F.transform("labels", lambda x: F.array_join(x.cast("array<string>"), ",")), ";").alias("labels"),
                    F.array_join(F.col("problems").cast("array<string>"), ",").alias("problems"), F.array_join("codes", ",").alias("codes"))
