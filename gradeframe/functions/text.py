"""Scalar text functions as Spark Columns (X16-X19 and friends).

All patterns are written so that Java regex (Spark) and RE2 (the DuckDB
oracle) read them the same way, and so that they agree with Python's
``str.split()`` / ``re`` on whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() treats as whitespace.
PY_WHITESPACE = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# a whitespace-separated token
WS_TOKEN = f"[^{PY_WHITESPACE}]+"
# the same characters, without the space
_OTHER_WHITESPACE = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                      0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Python's \w for str patterns: letters, numbers, underscore
PY_WORD = r"\p{L}\p{N}_"
# A run of word characters, or one character that is neither space nor word
PUNCT_TOKEN = f"[{PY_WORD}]+|[^{PY_WHITESPACE}{PY_WORD}]"


# NIST mteval-style normalisation, applied in this order.
# Language-independent replacements (literal text):
NIST_STRIP = [("<skipped>", ""), ("-\n", ""), ("\n", " ")]
# Entities unescaped (literal, in this order):
NIST_UNESCAPE = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]
# Tokenisation rules (Java regex, $n back references):
NIST_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),   # punctuation, apostrophe excluded
    (r"([^0-9])([\.,])", "$1 $2 "),                      # period / comma unless after a digit
    (r"([\.,])([^0-9])", " $1 $2"),                      # period / comma unless before a digit
    (r"([0-9])(-)", "$1 $2 "),                            # dash after a digit
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ws_tokens(text) -> Column:
    """Whitespace tokens of a text (``str.split()``): ``WS_TOKEN``'s
    matches, without matching (a class of so many ranges is slow)."""
    spaced = F.translate(_c(text), _OTHER_WHITESPACE, " " * len(_OTHER_WHITESPACE))
    return F.array_remove(F.split(spaced, " "), "")


def punct_tokens(text) -> Column:
    """Runs of word characters, or single other non-space characters."""
    return F.regexp_extract_all(_c(text), F.lit(PUNCT_TOKEN), 0)


def split_puncts(text) -> Column:
    """X18 as text: the punctuation-split tokens joined by single spaces."""
    return F.array_join(punct_tokens(text), " ")


def ngrams(tokens, n) -> Column:
    """The n-grams of a token array; empty when there are fewer than n
    tokens (guards ``sequence`` counting down, D9).

    Each n-gram is its tokens joined by one space.  Tokens never contain
    whitespace, so the key is unambiguous, hashes as a plain string (fast
    ``array_distinct`` / group keys) and is compact to shuffle.
    """
    t = _c(tokens)
    if isinstance(n, int):
        # fixed order: zip n shifted slices, O(len * n) per row
        if n == 1:
            return t
        k = F.size(t) - n + 1
        shifted = [F.slice(t, F.lit(j + 1), F.greatest(k, F.lit(1))) for j in range(n)]
        z = F.arrays_zip(*shifted)
        fields = [str(j) for j in range(n)]
        joined = F.transform(z, lambda e: F.concat_ws(" ", *[e[f] for f in fields]))
        return F.when(k >= 1, joined).otherwise(F.array().cast("array<string>"))
    k = F.size(t) - n + 1
    return F.when(k >= 1, F.transform(F.sequence(F.lit(1), k),
                                      lambda i: F.array_join(F.slice(t, i, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def pad_tokens(tokens, n: int, left: str | None = None, right: str | None = None) -> Column:
    """X19 option: pad a token array with n-1 symbols on the left/right."""
    t = _c(tokens)
    if left is not None:
        t = F.concat(F.array_repeat(F.lit(left), n - 1), t)
    if right is not None:
        t = F.concat(t, F.array_repeat(F.lit(right), n - 1))
    return t


def nist_normalize(text, preserve_case: bool = False) -> Column:
    """NIST mteval-style normalisation, returning the token array.

    strip ``<skipped>``, join hyphenated line ends, newlines to spaces,
    unescape ``&lt; &gt; &quot; &amp;``, lower-case, then split punctuation
    (apostrophe excluded), periods/commas unless next to a digit, and a dash
    after a digit.
    """
    s = _c(text)
    for a, b in NIST_STRIP:
        s = F.replace(s, F.lit(a), F.lit(b))
    for a, b in NIST_UNESCAPE:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    if not preserve_case:
        s = F.lower(s)
    for pattern, repl in NIST_RULES:
        s = F.regexp_replace(s, pattern, repl)
    return ws_tokens(s)
