"""Registered code-text queries (X1-X15, X23, P9-P11, G7) over the given
tables: ``pages.html`` (slashes, quotes, nested tags), ``documents.text``
(whole texts) and Java-like method text derived from ``part`` rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.functions import codetext as T
from gradeframe.functions.text import PY_WHITESPACE
from gradeframe.operators import grade as G
from gradeframe.plans import adapters as A
from gradeframe.plans import sqlbase as Q
from gradeframe.plans.catalog import r6, register

HREF = 'href="/([^"]+)"'
NL = "chr(10)"


def _methods(spark, d):
    """Java-like method text per part: a declaration line, a print line
    and a return line."""
    p = A.load(spark, d, "part")
    typ = F.when(F.col("p_size") % 3 == 0, "int").when(F.col("p_size") % 3 == 1, "boolean") \
        .otherwise("String")
    code = F.concat(F.lit("public "), typ, F.lit(" m"), F.col("p_partkey").cast("string"),
                    F.lit("(int a, int b) {\r\nSystem.out.println(a);\n  return "),
                    F.col("p_size").cast("string"), F.lit(";\n}"))
    return p.select("p_partkey", code.alias("code"))


METHODS_SQL = """m AS (SELECT p_partkey, 'public ' || CASE WHEN p_size % 3 = 0 THEN 'int'
  WHEN p_size % 3 = 1 THEN 'boolean' ELSE 'String' END || ' m' || CAST(p_partkey AS VARCHAR) ||
  '(int a, int b) {' || chr(13) || chr(10) || 'System.out.println(a);' || chr(10) || '  return ' ||
  CAST(p_size AS VARCHAR) || ';' || chr(10) || '}' AS code FROM part)"""


@register("X4_remove_prints", f"""WITH {METHODS_SQL}
SELECT p_partkey, replace(array_to_string(list_filter(string_split(code, {NL}),
  lambda l: NOT contains(l, 'System.out.print')), ''), chr(13), {NL}) AS cleaned FROM m""")
def x4(spark, d):
    m = _methods(spark, d)
    return m.select("p_partkey", T.remove_prints("code").alias("cleaned"))


@register("X5_function_features", f"""WITH {METHODS_SQL}
SELECT p_partkey, split_part(split_part(code, '(', 1), ' ', 3) AS name,
  split_part(code, ' ', 2) AS type FROM m""")
def x5(spark, d):
    m = _methods(spark, d)
    return m.select("p_partkey", T.function_name("code").alias("name"),
                    T.function_type("code").alias("type"))


@register("X6_main_function", f"""WITH {METHODS_SQL}
SELECT p_partkey, split_part(split_part(code, '(', 1), ' ', 3) AS name,
  split_part(code, ' ', 2) AS type FROM m""")
def x6(spark, d):
    m = _methods(spark, d)
    f = m.select("p_partkey", T.main_function("code", F.concat(F.lit("m"),
                 F.col("p_partkey").cast("string"))).alias("f"))
    return f.select("p_partkey", F.col("f.name").alias("name"), F.col("f.type").alias("type"))


@register("X7_signature_body", f"""WITH {METHODS_SQL}
SELECT p_partkey, trim(split_part(code, '{{', 1)) AS signature,
  trim(regexp_extract(code, '(?s)^[^{{]*\\{{(.*)\\}}', 1), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM m""")
def x7(spark, d):
    m = _methods(spark, d)
    return m.select("p_partkey", T.signature("code").alias("signature"), T.body("code").alias("body"))


@register("P10_is_valid_code", """SELECT lang, count(*) FILTER (WHERE len(t) >= 4
  AND len(list_filter(t, lambda x: x = 'int')) <= 200
  AND len(list_filter(t, lambda x: x = 'String')) <= 200
  AND len(list_filter(t, lambda x: x = 'boolean')) <= 200) AS valid, count(*) AS total
FROM (SELECT lang, regexp_extract_all(text, '[^""" + PY_WHITESPACE + """]+') AS t FROM documents) GROUP BY lang""")
def p10(spark, d):
    docs = A.load(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count_if(T.is_valid_code("text")).alias("valid"),
                                    F.count(F.lit(1)).alias("total"))


@register("X11_extract_links", f"""SELECT page_id, len(regexp_extract_all(html, '{HREF}', 1)) AS n_links,
  array_to_string(regexp_extract_all(html, '{HREF}', 1), '|') AS links FROM pages""")
def x11(spark, d):
    p = A.load(spark, d, "pages")
    links = T.extract_all("html", HREF, 1)
    return p.select("page_id", F.size(links).cast("long").alias("n_links"), F.array_join(links, "|").alias("links"))


# the same tokens without possessive quantifiers, which RE2 lacks and does not need
_R1_RE2 = r"""(?sm)//.*?$|/\*.*?\*/|'(?:\\.|[^\\'])*'|"(?:\\.|[^\\"])*"|[^/'"]+|.""".replace("'", "''")


@register("X15_strip_comments", f"""WITH t AS (SELECT page_id, array_to_string(list_transform(
  regexp_extract_all(html, '{_R1_RE2}'), lambda x: CASE WHEN starts_with(x, '//') OR starts_with(x, '/*')
  THEN ' ' ELSE x END), '') AS s FROM pages)
SELECT page_id, md5(array_to_string(list_filter(string_split(s, {NL}),
  lambda l: regexp_matches(l, '[^{PY_WHITESPACE}]')), {NL})) AS stripped_md5 FROM t""")
def x15(spark, d):
    p = A.load(spark, d, "pages")
    return p.select("page_id", F.md5(T.strip_comments("html")).alias("stripped_md5"))


@register("X9_output_lines", """SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) <= 1 THEN 0
  ELSE len(string_split(text, chr(10))) - 1 END AS n_lines FROM documents""")
def x9(spark, d):
    docs = A.load(spark, d, "documents")
    return docs.select("doc_id", F.size(T.output_lines("text")).cast("long").alias("n_lines"))


@register("X10_failed_runs", """SELECT count(*) FILTER (WHERE contains(text, 'compilation failed')
  OR upper(text) = 'TIMEOUT') AS failed, count(*) AS total FROM documents""")
def x10(spark, d):
    docs = A.load(spark, d, "documents")
    return docs.agg(F.count_if(G.failed_run("text")).alias("failed"), F.count(F.lit(1)).alias("total"))


def _errors(spark, d):
    """Errors of failed runs derived from pages.  A page's links are printed
    as the compiler's ``error:`` lines (even page ids) or as thrown
    ``Error:`` / ``Exception:`` lines (odd ones); a page without any link
    leaves text that no pattern finds, so its whole stderr is one error."""
    p = A.load(spark, d, "pages")
    compiled = F.col("page_id") % 2 == 1
    links = T.extract_all("html", HREF, 1)
    line = F.transform(links, lambda l: F.concat(F.when(~compiled, "M.java:1: error: ").when(l.contains("en/"), "java.lang.Error: ")
                                                 .otherwise("java.lang.Exception: "), l))
    stderr = F.when(F.size(links) > 0, F.array_join(line, "\n")).otherwise(F.lit("killed"))
    return p.select(F.col("page_id").alias("submission_id"), F.when(compiled, "run").otherwise("compile").alias("kind"),
                    F.explode(T.run_failures(stderr, compiled)).alias("message"))


ERR_SQL = f"""l AS (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS links FROM pages),
e2 AS (SELECT page_id AS submission_id, CASE WHEN page_id % 2 = 1 THEN 'run' ELSE 'compile' END AS kind,
  unnest(CASE WHEN len(links) = 0 OR links IS NULL THEN ['killed'] WHEN page_id % 2 = 0 THEN links
    ELSE list_transform(links, lambda x: CASE WHEN contains(x, 'en/') THEN 'Error' ELSE 'Exception' END) END) AS message FROM l)"""


@register("G7_error_report", f"""WITH {ERR_SQL}
SELECT count(DISTINCT submission_id) FILTER (WHERE kind = 'compile') AS compile_errors,
  count(DISTINCT submission_id) FILTER (WHERE kind = 'run') AS run_errors, count(*) AS total_errors,
  count(DISTINCT submission_id) AS failed_runs,
  round(count(*) / count(DISTINCT submission_id), 6) AS errors_per_failed_run,
  count(*) FILTER (WHERE contains(message, 'en/')) AS marker_errors,
  count(DISTINCT CASE WHEN contains(message, 'en/') THEN submission_id END) AS marker_runs,
  count(*) FILTER (WHERE NOT contains(message, 'en/')) AS other_errors,
  round(count(*) FILTER (WHERE NOT contains(message, 'en/')) / count(DISTINCT submission_id), 6)
    AS other_errors_per_failed_run FROM e2""")
def g7(spark, d):
    r = G.error_report(_errors(spark, d), marker="en/")
    return r.withColumns({c: F.round(c, 6) for c in ("errors_per_failed_run", "other_errors_per_failed_run")})


@register("A5_error_histogram", f"""WITH {ERR_SQL}
SELECT message, count(*) AS cnt FROM e2 GROUP BY message""")
def a5(spark, d):
    return G.error_histogram(_errors(spark, d))


@register("X23_tsv_columns", """SELECT split_part(l, chr(9), 1) AS id,
  coalesce(list_extract(string_split(l, chr(9)), 2), '') AS text FROM (
  SELECT CAST(item_id AS VARCHAR) || CASE WHEN item_id % 2 = 0 THEN chr(9) || lower(text) ELSE '' END AS l
  FROM benchmark)""")
def x23(spark, d):
    b = A.load(spark, d, "benchmark")
    line = F.concat(F.col("item_id").cast("string"),
                    F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("\t"), F.lower("text")))
                    .otherwise(F.lit("")))
    s = b.select(T.tsv_columns(line).alias("s"))
    return s.select("s.id", "s.text")


@register("X12_prompt_text", """SELECT item_id, 'Question: ' || replace(text, ':', '') || ' Student written code:'
  AS prompt FROM benchmark WHERE NOT contains(replace(text, ':', ''), 'student written code')""")
def x12(spark, d):
    b = A.load(spark, d, "benchmark").where(~T.has_separator("text"))
    return b.select("item_id", T.prompt_text("text").alias("prompt"))


@register("X13_binary_prompt_text", """SELECT l.l_orderkey, l.l_linenumber, 'Question: ' || replace(p.p_name, ':', '') ||
  chr(10) || 'test case input: ' || CAST(l.l_quantity AS VARCHAR) || chr(10) || 'expected output: ' ||
  l.l_linestatus || chr(10) || 'Student result:' || ' ' || CASE WHEN l.l_returnflag = 'N' THEN 'pass'
  ELSE 'fail' END AS prompt FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")
def x13(spark, d):
    li = A.load(spark, d, "lineitem")
    p = A.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    j = li.join(p, "l_partkey")
    return j.select("l_orderkey", "l_linenumber", T.binary_prompt_text(
        "p_name", F.col("l_quantity").cast("string"), "l_linestatus",
        F.col("l_returnflag") == "N").alias("prompt"))


@register("X14_case_pair_text", """SELECT l_orderkey, l_linenumber, 'Test case input: <' || CAST(l_quantity AS VARCHAR) ||
  '> Test case output: <' || l_linestatus || '>' AS pair FROM lineitem""")
def x14(spark, d):
    li = A.load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     T.case_pair_text(F.col("l_quantity").cast("string"), "l_linestatus").alias("pair"))


@register("X1_repair_inputs", """SELECT p_partkey, replace(rtrim(p_name || '\\"', '"'), '\\', '"') AS fixed_input,
  replace(rtrim(p_name || '\\"', '"'), '\\', '') AS fixed_expected FROM part""")
def x1(spark, d):
    p = A.load(spark, d, "part")
    raw = F.concat(F.col("p_name"), F.lit('\\"'))
    return p.select("p_partkey", T.repair_input(raw).alias("fixed_input"),
                    T.repair_expected(raw).alias("fixed_expected"))


@register("X3_join_inputs", """SELECT c_custkey, '"' || replace(rtrim(concat_ws(', ', c_name,
  CASE WHEN c_acctbal > 0 THEN c_mktsegment END), '"'), '\\', '') || '"' AS input,
  lower(CAST(c_acctbal > 0 AS VARCHAR)) AS expected FROM customer""")
def x3(spark, d):
    c = A.load(spark, d, "customer")
    second = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return c.select("c_custkey", T.join_inputs("c_name", second).alias("input"),
                    T.bool_text(F.col("c_acctbal") > 0).alias("expected"))


NL_ = "chr(10)"
X8_SQL = f"""WITH {METHODS_SQL},
t AS (SELECT l_orderkey, arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS p_partkey
  FROM lineitem GROUP BY l_orderkey),
pr AS (SELECT l.l_orderkey, string_agg('System.out.println(m' || CAST(t.p_partkey AS VARCHAR) || '(' || l.q
  || '));' || {NL_}, '' ORDER BY l.l_linenumber, l.q) AS prints FROM (SELECT l_orderkey, l_linenumber,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem) l JOIN t USING (l_orderkey) GROUP BY 1),
h AS (SELECT t.l_orderkey, 'm' || CAST(t.p_partkey AS VARCHAR) AS fn,
  'M' || CAST(t.p_partkey AS VARCHAR) || CAST(t.l_orderkey AS VARCHAR) AS cn, pr.prints,
  trim(split_part(m.code, '{{', 1)) AS sig,
  trim(regexp_extract(m.code, '(?s)^[^{{]*\\{{(.*)\\}}', 1), ' ' || chr(9) || {NL_} || chr(13)) AS body
  FROM t JOIN pr USING (l_orderkey) JOIN m ON t.p_partkey = m.p_partkey),
s AS (SELECT l_orderkey, 'public class ' || cn || '{{' || {NL_} || sig || '{{' || {NL_} || 'try {{' || {NL_} || body
  || {NL_} || '}} catch (Exception e) {{' || {NL_} || 'System.out.print("Error ");' || {NL_} || 'return -999;' || {NL_}
  || '}}' || {NL_} || '}}' || {NL_} || {NL_} || 'public void ' || fn || '_test(String []s){{' || {NL_} || prints
  || '}}' || {NL_} || {NL_} || 'public static void main(String []args){{' || {NL_} || cn || ' obj = new ' || cn
  || '();' || {NL_} || 'obj.' || fn || '_test(args);' || {NL_} || '}}' || {NL_} || {NL_} || '}}' || {NL_} AS src FROM h)
SELECT l_orderkey, CAST(length(src) AS INTEGER) AS length, md5(src) AS source_md5 FROM s"""


@register("X8_harness_source", X8_SQL)
def x8(spark, d):
    """One harness per order: the method text of its first part, the order's
    quantities as test inputs (an order has a handful of lines)."""
    m = _methods(spark, d)
    li = A.load(spark, d, "lineitem")
    tests = li.groupBy("l_orderkey").agg(
        F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("p_partkey"),
        F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int")
                                             .cast("string").alias("q")))).alias("t"))
    j = tests.join(m, "p_partkey")
    fn = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    src = T.harness_source("code", fn, F.concat(F.upper(fn), F.col("l_orderkey").cast("string")),
                           F.col("t.q"), F.lit("int"))
    return j.select("l_orderkey", F.length(src).alias("length"), F.md5(src).alias("source_md5"))


A11_SQL = f"""WITH {METHODS_SQL},
c AS (SELECT p_partkey % 5 AS v, p_partkey % 2 AS odd, 'm' || CAST(p_partkey AS VARCHAR) AS own, code FROM m),
g AS (SELECT CASE WHEN v = 3 OR (v = 4 AND odd = 1) THEN 'other' ELSE own END AS expected,
  CASE v WHEN 1 THEN replace(code, '(int a, int b)', '') WHEN 2 THEN replace(code, '}}', '')
    WHEN 4 THEN replace(code, ' m', ' h') || chr(10) || code ELSE code END AS code FROM c),
n AS (SELECT code, expected, regexp_extract_all(code, 'public \\w+ (\\w+)\\(', 1) AS names,
  (length(code) - length(replace(code, 'public', ''))) / 6 AS publics FROM g),
f AS (SELECT code, expected, CASE WHEN publics = 1 THEN names[1] WHEN list_contains(names, expected) THEN expected END
  AS name FROM n)
SELECT count(*) FILTER (WHERE name IS NULL) AS edge_cases,
  count(*) FILTER (WHERE name IS DISTINCT FROM expected) AS name_mismatch,
  count(*) FILTER (WHERE name IS NOT NULL AND contains(code, '}}')) AS valid, count(*) AS total FROM f"""


@register("A11_extraction_counters", A11_SQL)
def a11(spark, d):
    return G.extraction_counters(_a11_programs(spark, d))


# --- programs that take every branch ----------------------------------------------

def _programs(spark, d):
    """Programs of several methods per part, with the expected name: a public
    one before and one after it (0), a private one before the only public one
    (1), two public ones of which none has the name (2), declarations after
    comments and calls (3), no declaration (4)."""
    p, k, v = A.load(spark, d, "part"), F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    typ = F.element_at(F.array(*map(F.lit, ("int", "boolean", "String", "int[]"))), (F.col("p_size") % 4 + 1).cast("int"))

    def method(kind, t, name):
        return F.concat(F.lit(kind + " "), t, F.lit(" " + name), k, F.lit("(int a) {\n  return f(a);\n}\n"))
    own = method("public", typ, "m")
    code = (F.when(v == 0, F.concat(method("public", F.lit("int"), "h"), own, method("public", F.lit("char"), "z")))
            .when(v == 1, F.concat(method("private", F.lit("int"), "h"), own))
            .when(v == 2, F.concat(method("public", F.lit("int"), "h"), method("public", F.lit("char"), "z")))
            .when(v == 3, F.concat(F.lit("// public text\nf(private);\n"), own))
            .otherwise(F.lit("int a = 1;\nf(a);")))
    return p.select("p_partkey", F.concat(F.lit("m"), k).alias("expected"), code.alias("code"))


PROGRAMS_SQL = f"""a AS (SELECT p_partkey, p_partkey % 5 AS v, CAST(p_partkey AS VARCHAR) AS k,
  ['int', 'boolean', 'String', 'int[]'][p_size % 4 + 1] AS t, '(int a) {{' || {NL} || '  return f(a);' || {NL} || '}}' || {NL} AS e FROM part),
g AS (SELECT p_partkey, 'm' || k AS expected, CASE v
  WHEN 0 THEN 'public int h' || k || e || 'public ' || t || ' m' || k || e || 'public char z' || k || e
  WHEN 1 THEN 'private int h' || k || e || 'public ' || t || ' m' || k || e
  WHEN 2 THEN 'public int h' || k || e || 'public char z' || k || e
  WHEN 3 THEN '// public text' || {NL} || 'f(private);' || {NL} || 'public ' || t || ' m' || k || e
  ELSE 'int a = 1;' || {NL} || 'f(a);' END AS code FROM a)"""


@register("X5_first_declaration", f"""WITH {PROGRAMS_SQL},
l AS (SELECT p_partkey, list_filter(string_split(code, {NL}),
  lambda x: regexp_matches(x, 'public|private') AND contains(x, '('))[1] AS line FROM g),
w AS (SELECT p_partkey, string_split(line, ' ') AS w FROM l),
i AS (SELECT p_partkey, w, list_position(list_transform(w, lambda x: contains(x, '(')), true) AS i FROM w)
SELECT p_partkey, split_part(w[i], '(', 1) AS name, CASE WHEN i > 1 THEN w[i - 1] END AS type FROM i""")
def x5_first(spark, d):
    m = _programs(spark, d)
    return m.select("p_partkey", T.function_name("code").alias("name"), T.function_type("code").alias("type"))


@register("X6_among_methods", f"""WITH {PROGRAMS_SQL},
f AS (SELECT p_partkey, expected, regexp_extract_all(code, 'public (\\S+) (\\w+)\\(', 1) AS types,
  regexp_extract_all(code, 'public (\\S+) (\\w+)\\(', 2) AS names FROM g),
i AS (SELECT *, CASE WHEN len(names) = 1 THEN 1 ELSE list_position(names, expected) END AS i FROM f)
SELECT p_partkey, CASE WHEN i > 0 THEN names[i] END AS name, CASE WHEN i > 0 THEN types[i] END AS type FROM i""")
def x6_among(spark, d):
    f = _programs(spark, d).select("p_partkey", T.main_function("code", "expected").alias("f"))
    return f.select("p_partkey", F.col("f.name").alias("name"), F.col("f.type").alias("type"))


@register("X8_harness_types", f"""WITH a AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k, p_partkey % 2 AS helper,
  ['int', 'boolean', 'String', 'int[]', 'String[]'][p_size % 5 + 1] AS t,
  ['return -999;', 'return false;', 'return "ERROR";', 'return new int[] {{-999}};', 'return new String[] {{"ERROR"}};'][p_size % 5 + 1] AS r
  FROM part),
b AS (SELECT p_partkey, concat_ws({NL}, 'public class M' || k || '{{', 'public ' || t || ' m' || k || '(int a)' || '{{', 'try {{',
  CASE WHEN helper = 1 THEN 'return h(a);' || {NL} ELSE 'return a;' END, '}} catch (Exception e) {{',
  'System.out.print("Error ");', r, '}}', '}}', CASE WHEN helper = 1 THEN concat_ws({NL}, 'public int h(int a) {{', '  return a;', '}} ', '')
  ELSE '' END, 'public void m' || k || '_test(String []s){{', 'System.out.println(m' || k || '(' || k || '));',
  'System.out.println(m' || k || '(0));', '}}', '', 'public static void main(String []args){{',
  'M' || k || ' obj = new M' || k || '();', 'obj.m' || k || '_test(args);', '}}', '', '}}', '') AS source FROM a)
SELECT p_partkey, source FROM b""")
def x8_types(spark, d):
    """Harnesses of every return type, with and without a helper method."""
    p, k = A.load(spark, d, "part"), F.col("p_partkey").cast("string")
    typ = F.element_at(F.array(*map(F.lit, ("int", "boolean", "String", "int[]", "String[]"))), (F.col("p_size") % 5 + 1).cast("int"))
    code = F.concat(F.lit("public "), typ, F.lit(" m"), k, F.lit("(int a) {\n"), F.when(
        F.col("p_partkey") % 2 == 1, "  return h(a);\n}\npublic int h(int a) {\n  return a;\n}").otherwise("  return a;\n}"))
    return p.select("p_partkey", T.harness_source(code, F.concat(F.lit("m"), k), F.concat(F.lit("M"), k),
                                                  F.array(k, F.lit("0")), typ).alias("source"))


@register("X9_output_texts", f"""WITH s AS (SELECT doc_id, string_split(text, {NL}) AS l FROM documents)
SELECT doc_id, array_to_string(l[1:len(l) - 1], '|') AS lines FROM s""")
def x9_texts(spark, d):
    docs = A.load(spark, d, "documents")
    return docs.select("doc_id", F.array_join(T.output_lines("text"), "|").alias("lines"))


@register("X10_run_outputs", f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN contains(text, 'compilation failed')
  OR upper(text) = 'TIMEOUT' WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN contains(text, 'compilation failed')
  WHEN 4 THEN true ELSE contains(text, 'compilation failed') END AS failed FROM documents""")
def x10_outputs(spark, d):
    """Outputs that say so in the text, are a time-out, only mention one, or are plain."""
    t, v = F.col("text"), F.col("doc_id") % 6
    out = (F.when(v == 1, F.concat(t, F.lit("\nM.java: compilation failed\n"))).when(v == 2, F.lit("Timeout"))
           .when(v == 3, F.concat(F.lit("timeout\n"), t)).when(v == 4, F.lit("TIMEOUT"))
           .when(v == 5, F.concat(t, F.lit("\nCompilation Failed"))).otherwise(t))
    return A.load(spark, d, "documents").select("doc_id", out.alias("output")).select("doc_id", G.failed_run("output").alias("failed"))


@register("P10_repeated_words", """WITH t AS (SELECT doc_id, regexp_extract_all(repeat('int ', doc_id % 230) ||
  repeat('String ', (7 * doc_id) % 240) || repeat('boolean ', (11 * doc_id) % 250) || CASE WHEN doc_id % 3 > 0 THEN text ELSE '' END,
  '[^""" + PY_WHITESPACE + """]+') AS t FROM documents)
SELECT doc_id, len(t) >= 4 AND greatest(len(list_filter(t, lambda x: x = 'int')), len(list_filter(t, lambda x: x = 'String')),
  len(list_filter(t, lambda x: x = 'boolean'))) <= 200 AS valid FROM t""")
def p10_repeated(spark, d):
    """Texts with up to 249 of each counted word before them, or nothing after."""
    def words(word, n):
        return F.repeat(F.lit(word + " "), n.cast("int"))
    i = F.col("doc_id")
    code = F.concat(words("int", i % 230), words("String", 7 * i % 240), words("boolean", 11 * i % 250),
                    F.when(i % 3 > 0, F.col("text")).otherwise(""))
    return A.load(spark, d, "documents").select("doc_id", T.is_valid_code(code).alias("valid"))


def _a11_programs(spark, d):
    """Whole methods, ones without parameters, ones never closed, ones of
    another name, and pairs of methods with and without the expected name."""
    v, own = F.col("p_partkey") % 5, F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    code = F.col("code")
    changed = (F.when(v == 1, F.replace(code, F.lit("(int a, int b)"), F.lit("")))
               .when(v == 2, F.replace(code, F.lit("}"), F.lit("")))
               .when(v == 4, F.concat(F.replace(code, F.lit(" m"), F.lit(" h")), F.lit("\n"), code)).otherwise(code))
    other = (v == 3) | ((v == 4) & (F.col("p_partkey") % 2 == 1))
    return _methods(spark, d).select(changed.alias("code"), F.when(other, "other").otherwise(own).alias("expected"))


@register("G6_full_report", f"""WITH {Q.RUNS}, x AS ({A11_SQL})
SELECT count(*) AS n, round(avg(ga),6) AS gt_mean, round(avg(ea),6) AS gen_mean, round(avg((ga-ea)*(ga-ea)),6) AS mse,
  count(*) FILTER (WHERE gm>0 AND em=0) AS gt_only_output, (SELECT edge_cases FROM x) AS edge_cases,
  (SELECT name_mismatch FROM x) AS name_mismatch, (SELECT valid FROM x) AS valid, (SELECT total FROM x) AS total FROM t""")
def g6_full(spark, d):
    """G6 with the counters of the generated programs beside the scores."""
    r = G.comparison_report(G.compare_texts(A.run_texts(spark, d)), _a11_programs(spark, d))
    return r.select("n", *[r6(c).alias(c) for c in ("gt_mean", "gen_mean", "mse")], "gt_only_output", "edge_cases",
                    "name_mismatch", "valid", "total")
