"""DuckDB oracle SQL fragments shared by several registered queries.

These are the adapter definitions of FIXTURES.md written as SQL; the
registered Spark queries compute the same results with gradeframe
operators, and the driver compares the two at sf0.01.
"""

TEST_ORDER = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
              "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")

PRED = f"""pred AS (SELECT l_orderkey AS submission_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {TEST_ORDER}) AS BIGINT) AS test_no,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label,
  l_discount * 10 AS prob, (l_discount - 0.05) * 40 AS logit FROM lineitem)"""

RUNS = f"""k AS (SELECT l_orderkey AS submission_id,
   CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {TEST_ORDER}) AS BIGINT) AS test_no,
   CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS n, l_linestatus AS expected,
   CASE WHEN l_returnflag='N' THEN 'O' ELSE 'F' END AS gt_line,
   CASE WHEN l_discount>0.05 THEN 'O' ELSE 'F' END AS gen_line FROM lineitem),
gt AS (SELECT submission_id, test_no AS line_no, gt_line AS line FROM k
   WHERE submission_id%7<>0 AND (submission_id%11<>0 OR 2*test_no<=n+1)
   UNION ALL SELECT submission_id, test_no+n, 'X' FROM k
   WHERE submission_id%7<>0 AND submission_id%11<>0 AND submission_id%13=0),
gen AS (SELECT submission_id, test_no AS line_no, gen_line AS line FROM k WHERE submission_id%5<>0),
gl AS (SELECT submission_id, count(*) m FROM gt GROUP BY submission_id),
el AS (SELECT submission_id, count(*) m FROM gen GROUP BY submission_id),
j AS (SELECT k.submission_id, k.test_no, coalesce(gl.m,0) gm, coalesce(el.m,0) em, k.n,
   CASE WHEN gt.line=k.expected THEN 1 ELSE 0 END ge,
   CASE WHEN gen.line=k.expected THEN 1 ELSE 0 END ee FROM k
   LEFT JOIN gt ON k.submission_id=gt.submission_id AND k.test_no=gt.line_no
   LEFT JOIN gen ON k.submission_id=gen.submission_id AND k.test_no=gen.line_no
   LEFT JOIN gl ON k.submission_id=gl.submission_id
   LEFT JOIN el ON k.submission_id=el.submission_id),
g AS (SELECT *, CASE WHEN gm=0 OR gm>=2*n THEN 0 ELSE ge END gp,
   CASE WHEN em=0 OR em>=2*n THEN 0 ELSE ee END ep FROM j),
s AS (SELECT submission_id, max(n) n, max(gm) gm, max(em) em, avg(CAST(gp AS DOUBLE)) ga,
   avg(CAST(ep AS DOUBLE)) ea,
   avg(CASE WHEN ge=ee THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) agr,
   sum(gp*ep) tp, sum((1-gp)*ep) fp, sum(gp*(1-ep)) fn, sum((1-gp)*(1-ep)) tn
   FROM g GROUP BY submission_id),
t AS (SELECT *, CASE WHEN gm=0 THEN 0 WHEN ga=1 THEN 2 ELSE 1 END gs,
   CASE WHEN em=0 THEN 0 WHEN ea=1 THEN 2 ELSE 1 END es,
   CASE WHEN gm=0 AND em=0 THEN CAST(1 AS DOUBLE)
        WHEN gm=0 OR em=0 THEN CAST(0 AS DOUBLE) ELSE agr END agree FROM s)"""

PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS ref, b.text AS hyp FROM conversations a
JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant')"""

SUBS = """subs AS (SELECT user_id AS subject_id, event_type AS problem_id,
  event_id AS code_state_id, ts AS server_ts, value AS score, props FROM events)"""
