"""Code-text scalar functions (X1-X15, X23, P10) as Spark Columns.

Everything is a built-in expression (regex, split, higher-order array
functions), so it runs inside whole-stage code generation on whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeframe.functions.text import PY_WHITESPACE

# Prompt and harness text pieces.
PROMPT_SEPARATOR = "student written code"
PROMPT_PREFIX = "Question: "
PROMPT_SUFFIX = " Student written code:"
BINARY_PROMPT_PARTS = ("Question: ", "\ntest case input: ", "\nexpected output: ", "\nStudent result:")
INSTRUCTION_TC = ("Test case result prediction task: "
                  "You are simulating a student learning to program in Java. "
                  "Given an input problem and associated test case, predict whether the code "
                  "written by the student will pass or fail the test case. ")
INSTRUCTION_CODE = ("Code generation task: "
                    "You are simulating a student learning to program in Java. "
                    "Given an input problem, predict the code written by the student. ")
PRINT_MARKER = "System.out.print"
CATCH_RETURNS = {"int": "return -999;\n", "boolean": "return false;\n",
                 "String": 'return "ERROR";\n', "int[]": "return new int[] {-999};\n",
                 "String[]": 'return new String[] {"ERROR"};\n'}

# Regex patterns.
# Java comment / literal tokenizer (unix lines, dot-all, multi-line): line
# comments, block comments, char literals, string literals, other runs.
COMMENT_TOKENS = r"""(?dsm)//.*?$|/\*.*?\*/|'[^\\']*+(?:\\.[^\\']*+)*+'|"[^\\"]*+(?:\\.[^\\"]*+)*+"|[^/'"]+|."""
# compiler messages: text after 'error: ' up to the end of its line
COMPILE_ERROR = r"(?d)error: ([^\n]+?)(?:\n|$)"
# runtime failures: the class word of 'Exception: ...' / 'Error: ...'
RUN_ERROR = r"(?d)(Exception|Error): ([^\n]+?)(?:\n|$)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(text) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(text), f"^[{PY_WHITESPACE}]+|[{PY_WHITESPACE}]+$", "")


def repair_input(text) -> Column:
    """Strip trailing double quotes, then backslash -> double quote."""
    return F.replace(F.regexp_replace(_c(text), '"+$', ""), F.lit("\\"), F.lit('"'))


def repair_expected(text) -> Column:
    """Strip trailing double quotes, then remove backslashes."""
    return F.replace(F.regexp_replace(_c(text), '"+$', ""), F.lit("\\"), F.lit(""))


def join_inputs(*parts) -> Column:
    """X3 input: non-null parts joined with ', ', trailing quotes and
    backslashes removed, wrapped in double quotes."""
    j = F.concat_ws(", ", *[_c(p) for p in parts])
    return F.concat(F.lit('"'), repair_expected(j), F.lit('"'))


def bool_text(x) -> Column:
    """X3 expected: bool-like value as lower-case text."""
    return F.lower(_c(x).cast("string"))


def remove_prints(code) -> Column:
    """Drop lines containing a print call, join the rest with no
    separator, then carriage returns become newlines."""
    lines = F.split(_c(code), "\n")
    kept = F.filter(lines, lambda l: ~l.contains(PRINT_MARKER))
    return F.replace(F.array_join(kept, ""), F.lit("\r"), F.lit("\n"))


def _features(piece: Column) -> tuple[Column, Column]:
    """X5 core: in the first line with public/private and a word holding
    '(', the method name is that word up to '(' and the type is the word
    before it (NULL when the '(' word is first, D7).  Both are NULL where no
    line declares a method."""
    lines = F.split(piece, "\n")
    cand = F.filter(lines, lambda l: (l.contains("public") | l.contains("private"))
                    & F.exists(F.split(l, " "), lambda w: w.contains("(")))
    words = F.split(F.try_element_at(cand, F.lit(1)), " ")
    idx = F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))),
                                lambda i: F.try_element_at(words, i).contains("(")), F.lit(1))
    name = F.substring_index(F.try_element_at(words, idx), "(", 1)
    typ = F.when(idx > 1, F.get(words, idx - 2))
    return name, typ


def function_name(code) -> Column:
    """Method name of the first declared method."""
    return _features(_c(code))[0]


def function_type(code) -> Column:
    """Return type of the first declared method."""
    return _features(_c(code))[1]


def main_function(code, expected_name) -> Column:
    """(name, type) struct of the main method: with one ``public`` the
    last piece; otherwise the piece whose method name equals
    ``expected_name``."""
    c = _c(code)
    pieces = F.split(c, "(?=public)")
    n_public = F.size(F.regexp_extract_all(c, F.lit("public"), 0))
    last = F.element_at(pieces, -1)
    match = F.try_element_at(F.filter(pieces, lambda p: _features(p)[0] == _c(expected_name)), F.lit(1))
    piece = F.when(n_public == 1, last).otherwise(match)
    name, typ = _features(piece)
    return F.struct(name.alias("name"), typ.alias("type"))


def signature(code) -> Column:
    """Text before the first '{', stripped."""
    return py_strip(F.substring_index(py_strip(code), "{", 1))


def body(code) -> Column:
    """Text between the first '{' and the last '}', stripped."""
    return py_strip(F.regexp_extract(py_strip(code), r"(?s)^[^{]*\{(.*)\}", 1))


def harness_source(code, fn, class_name, inputs, output_type) -> Column:
    """X8 (re-aimed): the complete test-harness source for one submission.

    A class wrapping the submission (its body in try/catch with a typed
    fallback return; a helper method after an inner ``public`` is moved
    out), a test method printing ``fn(input)`` per test input, and a main.
    """
    sig, bd = signature(code), body(code)
    start = F.regexp_instr(bd, F.lit(r"\bpublic\b"))
    prefix = F.substring(bd, F.lit(1), start - 1)
    p = F.instr(F.reverse(prefix), "}")
    end = F.when(p == 0, F.length(bd) - 1).otherwise(F.length(prefix) - p)
    main_part = F.when(start > 0, F.substring(bd, F.lit(1), end)).otherwise(bd)
    helper = F.when(start > 0, F.concat(F.substring(bd, start, 1 << 30), F.lit("\n} \n"))) \
        .otherwise(F.lit(""))
    ot = _c(output_type)
    ret = F.lit("")
    for t, r in CATCH_RETURNS.items():
        ret = F.when(ot == t, F.lit(r)).otherwise(ret)
    wrapped = F.concat(sig, F.lit("{\ntry {\n"), main_part,
                       F.lit('\n} catch (Exception e) {\nSystem.out.print("Error ");\n'), ret,
                       F.lit("}\n}\n"), helper)
    f = _c(fn)
    prints = F.array_join(F.transform(_c(inputs), lambda x: F.concat(
        F.lit("System.out.println("), f, F.lit("("), x, F.lit("));\n"))), "")
    test_fn = F.concat(F.lit("public void "), f, F.lit("_test(String []s){\n"), prints, F.lit("}\n"))
    cn = _c(class_name)
    main_fn = F.concat(F.lit("public static void main(String []args){\n"), cn, F.lit(" obj = new "),
                       cn, F.lit("();\nobj."), f, F.lit("_test(args);\n}\n"))
    return F.concat(F.lit("public class "), cn, F.lit("{\n"), wrapped, F.lit("\n"), test_fn,
                    F.lit("\n"), main_fn, F.lit("\n}\n"))


def output_lines(output) -> Column:
    """Output text -> lines without the last element (guarded)."""
    parts = F.split(_c(output), "\n")
    return F.when(F.size(parts) <= 1, F.array().cast("array<string>")) \
        .otherwise(F.slice(parts, 1, F.size(parts) - 1))


def compile_errors(stderr) -> Column:
    """X11: every ``error: <message>`` up to the end of its line."""
    return F.regexp_extract_all(_c(stderr), F.lit(COMPILE_ERROR), 1)


def run_errors(stderr) -> Column:
    """X11: the class word (Exception / Error) of every ``...: message``."""
    return F.regexp_extract_all(_c(stderr), F.lit(RUN_ERROR), 1)


def run_failures(stderr, compiled) -> Column:
    """X11: the messages of one failed run: compile errors where ``compiled``
    is false, else runtime classes; the whole stderr is the one message where
    none is found."""
    found = F.when(_c(compiled), run_errors(stderr)).otherwise(compile_errors(stderr))
    return F.when(F.size(found) > 0, found).otherwise(F.array(_c(stderr)))


def extract_all(text, pattern: str, group: int = 1) -> Column:
    """X11 in general form: all matches of ``pattern`` (one group)."""
    return F.regexp_extract_all(_c(text), F.lit(pattern), group)


def prompt_text(prompt, bos: str | None = None, instruction: str | None = None) -> Column:
    """Prompt text: ':' removed, 'Question: ' ... ' Student written
    code:', with an optional BOS token and instruction prefix ('tc' or
    'code').  Rows whose prompt holds the separator phrase must be
    rejected first (:func:`has_separator`)."""
    p = F.replace(_c(prompt), F.lit(":"), F.lit(""))
    out = F.concat(F.lit(PROMPT_PREFIX), p, F.lit(PROMPT_SUFFIX))
    if bos:
        out = F.concat(F.lit(bos), out)
    if instruction:
        out = F.concat(F.lit(INSTRUCTION_TC if instruction == "tc" else INSTRUCTION_CODE), out)
    return out


def has_separator(prompt) -> Column:
    return F.replace(_c(prompt), F.lit(":"), F.lit("")).contains(PROMPT_SEPARATOR)


def binary_prompt_text(prompt, test_input, expected, passed=None, eos: str = "",
                       instruction: str | None = None) -> Column:
    """Test-result prompt; with ``passed`` the ' pass'/' fail' answer
    and the EOS token are appended."""
    q, i, e, r = BINARY_PROMPT_PARTS
    p = F.replace(_c(prompt), F.lit(":"), F.lit(""))
    out = F.concat(F.lit(q), p, F.lit(i), _c(test_input), F.lit(e), _c(expected), F.lit(r))
    if instruction:
        out = F.concat(F.lit(INSTRUCTION_TC if instruction == "tc" else INSTRUCTION_CODE), out)
    if passed is not None:
        out = F.concat(out, F.lit(" "), F.when(_c(passed).cast("boolean"), "pass").otherwise("fail"),
                       F.lit(eos))
    return out


def case_pair_text(test_input, expected, question=None) -> Column:
    """X14: 'Test case input: <i> Test case output: <o>' (question first)."""
    t = F.concat(F.lit("Test case input: <"), _c(test_input), F.lit("> Test case output: <"),
                 _c(expected), F.lit(">"))
    return F.concat(_c(question), F.lit(" "), t) if question is not None else t


def strip_comments(source) -> Column:
    """Java comment removal: comment tokens become one space, string
    and char literals survive, blank lines are dropped (D8)."""
    toks = F.regexp_extract_all(_c(source), F.lit(COMMENT_TOKENS), 0)
    replaced = F.transform(toks, lambda t: F.when(t.startswith("//") | t.startswith("/*"), F.lit(" "))
                           .otherwise(t))
    lines = F.split(F.array_join(replaced, ""), "\n")
    kept = F.filter(lines, lambda l: l.rlike(f"[^{PY_WHITESPACE}]"))
    return F.array_join(kept, "\n")


def is_valid_code(code, max_count: int = 200, min_tokens: int = 4) -> Column:
    """P10: at most ``max_count`` of each of int / String / boolean tokens
    and at least ``min_tokens`` tokens.  The text is searched for them, never
    cut into an array of its tokens."""
    c = _c(code)
    ok = c.rlike(f"^[{PY_WHITESPACE}]*+(?:[^{PY_WHITESPACE}]++[{PY_WHITESPACE}]++){{{min_tokens - 1}}}[^{PY_WHITESPACE}]") \
        if min_tokens > 0 else F.length(c) >= 0
    for w in ("int", "String", "boolean"):
        # the word where white space or the text's end stands on both sides
        ok = ok & (F.regexp_count(c, F.lit(f"{w}(?![^{PY_WHITESPACE}])(?<![^{PY_WHITESPACE}]{w})")) <= max_count)
    return ok


def tsv_columns(line) -> Column:
    """X23: 'id<TAB>text' -> struct(id, text); text '' when absent."""
    parts = F.split(py_strip(line), "\t")
    return F.struct(F.element_at(parts, 1).alias("id"),
                    F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("text"))
