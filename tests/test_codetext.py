"""Code-text functions (X1-X15, X23, P10) against the worked cases."""

from pyspark.sql import functions as F

from gradeframe.functions import codetext as T


def _one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)],
                               ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).collect()[0].x


def test_repairs(spark):
    assert _one(spark, T.repair_input("t"), t='\\bread\\""') == '"bread"'
    assert _one(spark, T.repair_expected("t"), t='\\bread\\""') == "bread"
    assert _one(spark, T.join_inputs("a", "b"), a="a", b=None) == '"a"'
    assert _one(spark, T.bool_text(F.lit(True))) == "true"


def test_remove_prints(spark):
    assert _one(spark, T.remove_prints("c"), c="a\nSystem.out.println(1);\nb") == "ab"
    assert _one(spark, T.remove_prints("c"), c="a\r\nb") == "a\nb"


def test_function_features(spark):
    code = "public int loneSum(int a, int b) {\n return a + b;\n}"
    assert _one(spark, T.function_name("c"), c=code) == "loneSum"
    assert _one(spark, T.function_type("c"), c=code) == "int"
    # '(' in the first word: NULL type
    assert _one(spark, T.function_type("c"), c="public foo(int a) {}") == "public"
    assert _one(spark, T.function_type("c"), c="foo(int a) public {}") is None
    two = ("public int helper(int x) {\n return x;\n}\n"
           "public boolean main(int a) {\n return helper(a) > 0;\n}")
    m = _one(spark, T.main_function("c", F.lit("main")), c=two)
    assert (m.name, m.type) == ("main", "boolean")


def test_signature_body(spark):
    code = "  public int f(int a) {\n  if (a) { return 1; }\n  return 0;\n}\n"
    assert _one(spark, T.signature("c"), c=code) == "public int f(int a)"
    assert _one(spark, T.body("c"), c=code) == "if (a) { return 1; }\n  return 0;"


def test_harness_moves_helper_out(spark):
    # the whole text is one method whose body holds a second 'public'
    src = _one(spark, T.harness_source("c", F.lit("f"), F.lit("F1"), F.array(F.lit("3")),
                                       F.lit("int")), c="public int f(int a) {\n return 1;\n}\n"
                                                        "public int g(int b) {\n return b;\n}\n}")
    assert src.startswith("public class F1{\npublic int f(int a){\ntry {\n")
    assert "public int g(int b)" in src and "System.out.println(f(3));" in src
    assert "return -999;" in src and src.endswith("obj.f_test(args);\n}\n\n}\n")


def test_output_lines_and_errors(spark):
    assert _one(spark, T.output_lines("o"), o="1\n2\n") == ["1", "2"]
    assert _one(spark, T.output_lines("o"), o="x") == []
    err = "A.java:3: error: cannot find symbol\n  x\nA.java:5: error: ';' expected"
    assert _one(spark, T.compile_errors("e"), e=err) == ["cannot find symbol", "';' expected"]
    run = "Exception in thread main java.lang.ArithmeticException: / by zero\n"
    assert _one(spark, T.run_errors("e"), e=run) == ["Exception"]


def test_strip_comments(spark):
    src = 'String u = "http://x"; // c\n\n  /* block\n */ int y = 1/2;\n'
    assert _one(spark, T.strip_comments("s"), s=src) == 'String u = "http://x";  \n    int y = 1/2;'
    assert _one(spark, T.strip_comments("s"), s="char c = '/'; // x") == "char c = '/';  "


def test_valid_code_and_tsv(spark):
    assert _one(spark, T.is_valid_code("c"), c="int a = 1;") is True
    assert _one(spark, T.is_valid_code("c"), c="int a") is False
    assert _one(spark, T.is_valid_code("c"), c=" ".join(["int"] * 201)) is False
    r = _one(spark, T.tsv_columns("l"), l="7\thello")
    assert (r.id, r.text) == ("7", "hello")
    assert _one(spark, T.tsv_columns("l"), l="8").text == ""


def test_valid_code_is_found_by_search(spark):
    """Words count between white space only, and no array of tokens is made."""
    texts = ["int\u3000int\x1cint ints xint \U0001F600int int\U0001F600", "\t int\nString\x85boolean x", "String String\xa0", "int", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for count, tokens in ((1, 4), (3, 3), (2, 0), (0, 1)):
        want = [None if t is None else len(t.split()) >= tokens and all(t.split().count(w) <= count for w in ("int", "String", "boolean"))
                for t in texts]
        got = df.select(T.is_valid_code("c", count, tokens).alias("v"))
        assert [r.v for r in got.collect()] == want
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_prompts(spark):
    assert _one(spark, T.prompt_text("p"), p="Sum: two") == "Question: Sum two Student written code:"
    got = _one(spark, T.binary_prompt_text("p", F.lit("1"), F.lit("2"), F.lit(True), "</s>"), p="q")
    assert got == "Question: q\ntest case input: 1\nexpected output: 2\nStudent result: pass</s>"
    assert _one(spark, T.case_pair_text(F.lit("1"), F.lit("2"))) == \
        "Test case input: <1> Test case output: <2>"


def test_run_failures_falls_back_to_the_whole_stderr(spark):
    rows = [("M.java:3: error: ';' expected\n  x\nM.java:9: error: missing", False), ("out of memory", False),
            ("Exception in thread: a\njava.lang.Error: b", True), ("killed", True), ("", False)]
    got = spark.createDataFrame(rows, "err string, ok boolean").select(T.run_failures("err", "ok").alias("m")).collect()
    assert [r.m for r in got] == [["';' expected", "missing"], ["out of memory"], ["Error"], ["killed"], [""]]
