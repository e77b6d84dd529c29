"""Registered text-metric queries on user/assistant turn pairs
(X16, X18, X19, B1-B5, B10, B12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.functions import text as X
from gradeframe.operators import bleu as B
from gradeframe.plans import adapters as A
from gradeframe.plans import sqlbase as Q
from gradeframe.plans.catalog import r6, register

KEY = ["conv_id", "turn"]
WS = X.WS_TOKEN

TOK = f"""tok AS (SELECT conv_id, turn, regexp_extract_all(hyp, '{WS}') AS ht,
  regexp_extract_all(ref, '{WS}') AS rt FROM pairs),
ord AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT conv_id, turn, n, array_to_string(ht[i:i+n-1], ' ') AS g FROM
  (SELECT conv_id, turn, ht, n, unnest(range(1, len(ht)-n+2)) AS i FROM tok, ord)),
rg AS (SELECT conv_id, turn, n, array_to_string(rt[i:i+n-1], ' ') AS g FROM
  (SELECT conv_id, turn, rt, n, unnest(range(1, len(rt)-n+2)) AS i FROM tok, ord)),
hc AS (SELECT conv_id, turn, n, g, count(*) AS c FROM hg GROUP BY ALL),
rc AS (SELECT conv_id, turn, n, g, count(*) AS c FROM rg GROUP BY ALL),
mp AS (SELECT conv_id, turn, n, sum(least(hc.c, rc.c)) AS m FROM hc JOIN rc USING (conv_id, turn, n, g)
  GROUP BY ALL)"""


def _stats_sql(group: bool) -> str:
    g = "conv_id, turn, " if group else ""
    gb = "GROUP BY conv_id, turn" if group else ""
    join = "LEFT JOIN mp USING (conv_id, turn)" if group else "LEFT JOIN mp ON true"
    sums = ",\n  ".join(
        f"coalesce(sum(m) FILTER (WHERE n = {k}), 0) AS num_{k}" for k in range(1, 5))
    # lengths per pair are repeated once per matching order row: take them
    # from tok separately
    src = f"tok {join}" if group else "mp"
    return f"""ms AS (SELECT {g}{sums} FROM {src} {gb}),
ls AS (SELECT {g}sum(len(ht)) AS hl, sum(len(rt)) AS rl,
  {", ".join(f"sum(greatest(1, len(ht)-{k-1})) AS d{k}" for k in range(1, 5))},
  {", ".join(f"sum(greatest(0, len(ht)-{k-1})) AS g{k}" for k in range(1, 5))}
  FROM tok {gb}),
st AS (SELECT * FROM ms {"JOIN ls USING (conv_id, turn)" if group else ", ls"})"""


def _bleu_sql() -> str:
    logs = " + ".join(
        f"0.25*ln(CASE WHEN num_{k} = 0 THEN 0.1/d{k} ELSE num_{k}/d{k} END)" for k in range(1, 5))
    return (f"CASE WHEN num_1 = 0 THEN 0.0 ELSE (CASE WHEN hl > rl THEN 1.0 WHEN hl = 0 THEN 0.0 "
            f"ELSE exp(1 - rl/hl) END) * exp({logs}) END")


def _pstats(spark, d, by_pair: bool, tok=X.ws_tokens):
    """One-pass single-reference statistics over the turn pairs."""
    return B.pair_stats(A.text_pairs(spark, d), KEY, "hyp", "ref", tok, by_pair=by_pair)


def _sides(spark, d, tok=X.ws_tokens):
    return B.sides(A.text_pairs(spark, d), KEY, "hyp", "ref", tok)


@register("B1_corpus_bleu", f"""WITH {Q.PAIRS}, {TOK}, {_stats_sql(False)}
SELECT round({_bleu_sql()}, 6) AS bleu, CAST(num_1 AS BIGINT) AS num_1, CAST(num_2 AS BIGINT) AS num_2,
  CAST(num_3 AS BIGINT) AS num_3, CAST(num_4 AS BIGINT) AS num_4,
  CAST(hl AS BIGINT) AS hyp_len, CAST(rl AS BIGINT) AS ref_len FROM st""")
def b1(spark, d):
    s = B.bleu_from_stats(_pstats(spark, d, by_pair=False))
    return s.select(r6("bleu").alias("bleu"), "num_1", "num_2", "num_3", "num_4",
                    F.col("hyp_len").cast("long").alias("hyp_len"),
                    F.col("ref_closest").cast("long").alias("ref_len"))


@register("B2_sentence_bleu", f"""WITH {Q.PAIRS}, {TOK}, {_stats_sql(True)}
SELECT conv_id, turn, round({_bleu_sql()}, 6) AS bleu FROM st""")
def b2(spark, d):
    return B.bleu_from_stats(_pstats(spark, d, by_pair=True)).select(*KEY, r6("bleu").alias("bleu"))


@register("B3_nmt_bleu", f"""WITH {Q.PAIRS}, {TOK}, {_stats_sql(False)},
p AS (SELECT *, (num_1+1.0)/(g1+1) p1, (num_2+1.0)/(g2+1) p2, (num_3+1.0)/(g3+1) p3,
  (num_4+1.0)/(g4+1) p4, hl/rl AS ratio FROM st)
SELECT round(exp((ln(p1)+ln(p2)+ln(p3)+ln(p4))/4) * CASE WHEN ratio > 1 THEN 1.0
  ELSE exp(1 - 1/ratio) END, 6) AS bleu, round(p1,6) AS precision_1, round(p2,6) AS precision_2,
  round(p3,6) AS precision_3, round(p4,6) AS precision_4,
  round(CASE WHEN ratio > 1 THEN 1.0 ELSE exp(1 - 1/ratio) END, 6) AS bp, round(ratio,6) AS ratio,
  CAST(hl AS BIGINT) AS translation_length, CAST(rl AS BIGINT) AS reference_length FROM p""")
def b3(spark, d):
    s = B.nmt_bleu_from_stats(_pstats(spark, d, by_pair=False), smooth=True)
    return s.select(*[r6(c).alias(c) for c in ("bleu", "precision_1", "precision_2", "precision_3",
                                                "precision_4", "bp", "ratio")],
                    "translation_length", "reference_length")


def _distinct_sql(n: int) -> str:
    return (f"round(avg(CASE WHEN len(t) > 0 THEN len(list_distinct(list_transform(range(1, len(t)-{n}+2),"
            f" lambda i: array_to_string(t[i:i+{n}-1], ' ')))) / len(t) ELSE 0.0 END), 6) AS distinct_{n}")


@register("B5_distinct_n", f"""WITH {Q.PAIRS}, x AS (SELECT regexp_extract_all(hyp, '{WS}') AS t FROM pairs)
SELECT {_distinct_sql(1)}, {_distinct_sql(2)}, {_distinct_sql(3)} FROM x""")
def b5(spark, d):
    p = A.text_pairs(spark, d)
    out = B.distinct_ns(p, "hyp", [1, 2, 3], X.ws_tokens)
    return out.select(*[r6(f"distinct_{n}").alias(f"distinct_{n}") for n in (1, 2, 3)])


@register("X16_ws_tokens", f"""WITH {Q.PAIRS}
SELECT conv_id, turn, len(regexp_extract_all(hyp, '{WS}')) AS n_tokens,
  array_to_string(regexp_extract_all(hyp, '{WS}'), ' ') AS joined FROM pairs""")
def x16(spark, d):
    p = A.text_pairs(spark, d)
    t = X.ws_tokens("hyp")
    return p.select(*KEY, F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("joined"))


@register("X19_ngrams", f"""WITH {Q.PAIRS}, {TOK}
SELECT n, count(*) AS grams, count(DISTINCT g) AS distinct_grams FROM hg GROUP BY n""")
def x19(spark, d):
    h, _ = _sides(spark, d)
    g = B.gram_rows(h, KEY, 4)
    return g.groupBy("n").agg(F.count(F.lit(1)).alias("grams"),
                              F.count_distinct("gram").alias("distinct_grams"))


KW = ", ".join(f"('{k}')" for k in B.JAVA_KEYWORDS)


B10_CTES = f"""kw AS (SELECT * FROM (VALUES {KW}) v(g)),
j AS (SELECT rc.n, rc.conv_id, rc.turn, least(rc.c, coalesce(hc.c, 0)) *
   (CASE WHEN rc.n = 1 THEN (CASE WHEN kw.g IS NOT NULL THEN 1.0 ELSE 0.2 END) ELSE 1.0 END) AS cl,
   rc.c * (CASE WHEN rc.n = 1 THEN (CASE WHEN kw.g IS NOT NULL THEN 1.0 ELSE 0.2 END) ELSE 1.0 END) AS rw
  FROM rc LEFT JOIN hc USING (conv_id, turn, n, g) LEFT JOIN kw ON rc.g = kw.g),
pr AS (SELECT n, conv_id, turn, sum(cl) AS num, greatest(1.0, sum(rw)) AS den FROM j GROUP BY ALL),
full_ AS (SELECT o.n, coalesce(pr.num, 0.0) AS num, coalesce(pr.den, 1.0) AS den
  FROM tok, ord o LEFT JOIN pr ON pr.conv_id = tok.conv_id AND pr.turn = tok.turn AND pr.n = o.n),
s AS (SELECT {", ".join(f"sum(num) FILTER (WHERE n={k}) AS num_{k}, sum(den) FILTER (WHERE n={k}) AS d{k}" for k in range(1, 5))},
  (SELECT sum(len(ht)) FROM tok) AS hl, (SELECT 2.0 * count(*) FROM tok) AS rl FROM full_)"""


@register("B10_weighted_recall_bleu", f"""WITH {Q.PAIRS}, {TOK}, {B10_CTES}
SELECT round({_bleu_sql()}, 6) AS bleu, CAST(round(num_1, 6) AS DOUBLE) AS num_1, CAST(round(d1, 6) AS DOUBLE) AS den_1 FROM s""")
def b10(spark, d):
    st = B.weighted_pair_stats(A.text_pairs(spark, d), KEY, "hyp", "ref", X.ws_tokens)
    s = B.weighted_bleu_from_stats(st)
    return s.select(r6("bleu").alias("bleu"), r6("num_1").alias("num_1"), r6("den_1").alias("den_1"))


def _nist_tokens(c):
    return X.nist_normalize(X.split_puncts(F.lower(c)))


def _norm_sql(x: str) -> str:
    """The same normalisation in DuckDB SQL, built from the same fixed rules."""
    s = f"array_to_string(regexp_extract_all(lower({x}), '{X.PUNCT_TOKEN}'), ' ')"
    for a, b in X.NIST_STRIP + X.NIST_UNESCAPE:
        a_sql = a.replace("\n", "' || chr(10) || '")
        s = f"replace({s}, '{a_sql}', '{b}')"
    s = f"lower(' ' || {s} || ' ')"
    for pattern, repl in X.NIST_RULES:
        s = f"regexp_replace({s}, '{pattern}', '{repl.replace('$', chr(92))}', 'g')"
    return f"regexp_extract_all({s}, '{WS}')"


TOK_NIST = TOK.replace(f"regexp_extract_all(hyp, '{WS}')", _norm_sql("hyp")) \
    .replace(f"regexp_extract_all(ref, '{WS}')", _norm_sql("ref"))
TINY = "2.2250738585072014e-308"


@register("X17_nist_normalize", f"""WITH {Q.PAIRS}
SELECT conv_id, turn, len({_norm_sql('hyp')}) AS n_tokens,
  md5(array_to_string({_norm_sql('hyp')}, ' ')) AS tokens_md5 FROM pairs""")
def x17(spark, d):
    p = A.text_pairs(spark, d)
    t = _nist_tokens(F.col("hyp"))
    return p.select(*KEY, F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@register("X18_split_puncts", f"""WITH {Q.PAIRS}
SELECT conv_id, turn, md5(array_to_string(regexp_extract_all(hyp, '{X.PUNCT_TOKEN}'), ' ')) AS split_md5
FROM pairs""")
def x18(spark, d):
    p = A.text_pairs(spark, d)
    return p.select(*KEY, F.md5(X.split_puncts("hyp")).alias("split_md5"))


@register("B4_smoothed_pair_bleu", f"""WITH {Q.PAIRS}, {TOK_NIST}, {_stats_sql(True)},
b AS (SELECT exp(((ln(num_1 + {TINY}) - ln(g1 + {TINY}))
    + (ln(num_2 + 1 + {TINY}) - ln(g2 + 1 + {TINY})) + (ln(num_3 + 1 + {TINY}) - ln(g3 + 1 + {TINY}))
    + (ln(num_4 + 1 + {TINY}) - ln(g4 + 1 + {TINY}))) / 4 + least(0, 1 - (rl + 1) / (hl + 1))) AS b0,
  {", ".join(f"CASE WHEN g{k} = 0 THEN 0.0 ELSE exp(ln(num_{k} + {TINY}) - ln(g{k})) END AS b{k}" for k in range(1, 5))}
  FROM st)
SELECT round(avg(b0) * 100, 6) AS bleu, {", ".join(f"round(avg(b{k}) * 100, 6) AS bleu_{k}" for k in range(1, 5))} FROM b""")
def b4(spark, d):
    st = B.pair_stats(A.text_pairs(spark, d), KEY, "hyp", "ref", _nist_tokens, by_pair=True)
    s = B.smoothed_from_stats(st, KEY)
    return s.select(*[r6(c).alias(c) for c in ("bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4")])


@register("B12_sentence_smoothing", f"""WITH {Q.PAIRS}, {TOK}, {_stats_sql(True)}
SELECT conv_id, turn, round(CASE WHEN num_1 = 0 THEN 0.0 ELSE (CASE WHEN hl > rl THEN 1.0 WHEN hl = 0 THEN 0.0
  ELSE exp(1 - rl/hl) END) * exp({" + ".join(f"0.25*ln((num_{k} + 1.0)/(d{k} + 1))" for k in range(1, 5))}) END, 6) AS bleu
FROM st""")
def b12(spark, d):
    st = _pstats(spark, d, by_pair=True)
    return B.bleu_from_stats(st, smoothing="method2").select(*KEY, r6("bleu").alias("bleu"))


def _sent_sql(p_exprs: list[str]) -> str:
    logs = " + ".join(f"0.25*ln({p})" for p in p_exprs)
    return (f"CASE WHEN num_1 = 0 THEN 0.0 ELSE (CASE WHEN hl > rl THEN 1.0 WHEN hl = 0 THEN 0.0 "
            f"ELSE exp(1 - rl/hl) END) * exp({logs}) END")


_M3 = [f"CASE WHEN num_{k} = 0 THEN 1.0 / (pow(2, {' + '.join(f'(num_{j} = 0)::INT' for j in range(1, k + 1))}) * d{k}) "
       f"ELSE num_{k} / d{k} END" for k in range(1, 5)]
_M4 = [f"CASE WHEN num_{k} = 0 AND hl <> 0 THEN ({k - 1} + 5.0 / nullif(ln(hl), 0)) / d{k} ELSE num_{k} / d{k} END"
       for k in range(1, 5)]


@register("B12_sentence_method3", f"""WITH {Q.PAIRS}, {TOK}, {_stats_sql(True)}
SELECT conv_id, turn, round({_sent_sql(_M3)}, 6) AS bleu FROM st""")
def b12m3(spark, d):
    st = _pstats(spark, d, by_pair=True)
    return B.bleu_from_stats(st, smoothing="method3").select(*KEY, r6("bleu").alias("bleu"))


@register("B12_sentence_method4", f"""WITH {Q.PAIRS}, {TOK}, {_stats_sql(True)}
SELECT conv_id, turn, round({_sent_sql(_M4)}, 6) AS bleu FROM st""")
def b12m4(spark, d):
    st = _pstats(spark, d, by_pair=True)
    return B.bleu_from_stats(st, smoothing="method4").select(*KEY, r6("bleu").alias("bleu"))


@register("B3_nmt_bleu_plain", f"""WITH {Q.PAIRS}, {TOK}, {_stats_sql(False)},
p AS (SELECT *, CASE WHEN g1 > 0 THEN num_1 / g1 ELSE 0.0 END p1, CASE WHEN g2 > 0 THEN num_2 / g2 ELSE 0.0 END p2,
  CASE WHEN g3 > 0 THEN num_3 / g3 ELSE 0.0 END p3, CASE WHEN g4 > 0 THEN num_4 / g4 ELSE 0.0 END p4,
  hl / rl AS ratio FROM st)
SELECT round(CASE WHEN least(p1, p2, p3, p4) > 0 THEN exp((ln(p1)+ln(p2)+ln(p3)+ln(p4))/4) ELSE 0.0 END
  * CASE WHEN ratio > 1 THEN 1.0 ELSE exp(1 - 1/ratio) END, 6) AS bleu,
  round(p1, 6) AS precision_1, round(p4, 6) AS precision_4 FROM p""")
def b3p(spark, d):
    s = B.nmt_bleu_from_stats(_pstats(spark, d, by_pair=False), smooth=False)
    return s.select(*[r6(c).alias(c) for c in ("bleu", "precision_1", "precision_4")])


@register("B5_distinct_n_punct", f"""WITH {Q.PAIRS}, x AS (SELECT regexp_extract_all(hyp, '{X.PUNCT_TOKEN}') AS t FROM pairs)
SELECT {_distinct_sql(1)}, {_distinct_sql(2)}, {_distinct_sql(3)} FROM x""")
def b5p(spark, d):
    """B5 with the punctuation-splitting tokenizer (D11 option)."""
    out = B.distinct_ns(A.text_pairs(spark, d), "hyp", [1, 2, 3], X.punct_tokens)
    return out.select(*[r6(f"distinct_{n}").alias(f"distinct_{n}") for n in (1, 2, 3)])


@register("X16_document_tokens", f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{WS}')) AS BIGINT) AS n_tokens,
  md5(array_to_string(regexp_extract_all(text, '{WS}'), ' ')) AS tokens_md5 FROM documents""")
def x16d(spark, d):
    """X16 over whole documents (up to 20,000 words each)."""
    docs = A.load(spark, d, "documents")
    t = X.ws_tokens("text")
    return docs.select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                       F.md5(F.array_join(t, " ")).alias("tokens_md5"))


# --- one-text operators over all turns of all conversations -------------------

TURNS = "turns AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)"


@register("X16_turn_tokens", f"""WITH {TURNS}
SELECT conv_id, turn, len(regexp_extract_all(t, '{WS}')) AS n_tokens,
  array_to_string(regexp_extract_all(t, '{WS}'), ' ') AS joined FROM turns""")
def x16t(spark, d):
    t = X.ws_tokens("t")
    return A.all_turns(spark, d).select(*KEY, F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("joined"))


@register("X17_turn_nist_normalize", f"""WITH {TURNS}
SELECT conv_id, turn, len({_norm_sql('t')}) AS n_tokens,
  md5(array_to_string({_norm_sql('t')}, ' ')) AS tokens_md5 FROM turns""")
def x17t(spark, d):
    t = _nist_tokens(F.col("t"))
    return A.all_turns(spark, d).select(*KEY, F.size(t).cast("long").alias("n_tokens"),
                                        F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@register("X18_turn_split_puncts", f"""WITH {TURNS}
SELECT conv_id, turn, md5(array_to_string(regexp_extract_all(t, '{X.PUNCT_TOKEN}'), ' ')) AS split_md5
FROM turns""")
def x18t(spark, d):
    return A.all_turns(spark, d).select(*KEY, F.md5(X.split_puncts("t")).alias("split_md5"))


@register("X19_turn_ngrams", f"""WITH {TURNS}, tok AS (SELECT regexp_extract_all(t, '{WS}') AS ht FROM turns),
o AS (SELECT ht, unnest([1, 2, 3, 4]) AS n FROM tok),
i AS (SELECT ht, n, unnest(range(1, len(ht)-n+2)) AS i FROM o),
g AS (SELECT n, array_to_string(ht[i:i+n-1], ' ') AS g FROM i)
SELECT n, count(*) AS grams, count(DISTINCT g) AS distinct_grams FROM g GROUP BY n""")
def x19t(spark, d):
    h = A.all_turns(spark, d).select(*KEY, X.ws_tokens("t").alias("tokens"))
    return B.gram_rows(h, KEY, 4).groupBy("n").agg(F.count(F.lit(1)).alias("grams"),
                                                   F.count_distinct("gram").alias("distinct_grams"))


@register("B5_turn_distinct_n", f"""WITH {TURNS}, x AS (SELECT regexp_extract_all(turns.t, '{WS}') AS t FROM turns)
SELECT {_distinct_sql(1)}, {_distinct_sql(2)}, {_distinct_sql(3)} FROM x""")
def b5t(spark, d):
    out = B.distinct_ns(A.all_turns(spark, d), "t", [1, 2, 3], X.ws_tokens)
    return out.select(*[r6(f"distinct_{n}").alias(f"distinct_{n}") for n in (1, 2, 3)])


@register("B5_turn_distinct_n_punct", f"""WITH {TURNS}, x AS (SELECT regexp_extract_all(turns.t, '{X.PUNCT_TOKEN}') AS t FROM turns)
SELECT {_distinct_sql(1)}, {_distinct_sql(2)}, {_distinct_sql(3)} FROM x""")
def b5pt(spark, d):
    out = B.distinct_ns(A.all_turns(spark, d), "t", [1, 2, 3], X.punct_tokens)
    return out.select(*[r6(f"distinct_{n}").alias(f"distinct_{n}") for n in (1, 2, 3)])


# --- several references a reply (A12) ------------------------------------------

def _multi_sql(ht: str, rt: str) -> str:
    """Statistics per reply: clipping by the largest count over the references."""
    nums = ", ".join(f"coalesce(sum(least(hc.c, xc.c)) FILTER (WHERE hc.n = {k}), 0) AS num_{k}" for k in range(1, 5))
    sizes = ", ".join(f"greatest(1, len(ht)-{k - 1}) AS d{k}, greatest(0, len(ht)-{k - 1}) AS g{k}" for k in range(1, 5))
    return f"""{Q.PAIRS}, tok AS (SELECT conv_id, turn, {ht} AS ht FROM (SELECT conv_id, turn, coalesce(hyp, '') AS hyp FROM pairs)),
rf AS (SELECT conv_id, turn, ref_no, {rt} AS rt FROM (SELECT p.conv_id, p.turn, (c.turn - p.turn) // 2 AS ref_no,
  coalesce(c.text, '') AS ref FROM pairs p JOIN conversations c ON c.conv_id = p.conv_id AND c.role = 'user'
  AND c.turn IN (p.turn, p.turn + 2, p.turn + 4))),
ord AS (SELECT unnest([1, 2, 3, 4]) AS n),
hc AS (SELECT conv_id, turn, n, array_to_string(ht[i:i+n-1], ' ') AS g, count(*) AS c FROM
  (SELECT conv_id, turn, ht, n, unnest(range(1, len(ht)-n+2)) AS i FROM tok, ord) GROUP BY ALL),
rc AS (SELECT conv_id, turn, ref_no, n, array_to_string(rt[i:i+n-1], ' ') AS g, count(*) AS c FROM
  (SELECT conv_id, turn, ref_no, rt, n, unnest(range(1, len(rt)-n+2)) AS i FROM rf, ord) GROUP BY ALL),
xc AS (SELECT conv_id, turn, n, g, max(c) AS c FROM rc GROUP BY ALL),
mp AS (SELECT hc.conv_id, hc.turn, {nums} FROM hc JOIN xc USING (conv_id, turn, n, g) GROUP BY 1, 2),
rl AS (SELECT conv_id, turn, min({{'d': abs(len(rt) - len(ht)), 'l': len(rt)}}).l AS closest, min(len(rt)) AS shortest,
  min({{'d': abs(len(rt) - len(ht)), 'i': ref_no, 'l': len(rt)}}).l AS first_closest, avg(len(rt)) AS average
  FROM rf JOIN tok USING (conv_id, turn) GROUP BY ALL),
per AS (SELECT tok.conv_id, tok.turn, {", ".join(f"coalesce(num_{k}, 0) AS num_{k}" for k in range(1, 5))}, {sizes},
  len(ht) AS hl, closest, shortest, first_closest, average
  FROM tok JOIN rl USING (conv_id, turn) LEFT JOIN mp USING (conv_id, turn))"""


_MULTI = _multi_sql(f"regexp_extract_all(hyp, '{WS}')", f"regexp_extract_all(ref, '{WS}')")
_MULTI_NIST = _multi_sql(_norm_sql("hyp"), _norm_sql("ref"))
_SUMS = ", ".join(f"sum({c}) AS {c}" for c in ("hl", "closest", "shortest", *(f"{p}{k}" for p in ("num_", "d", "g")
                                                                             for k in range(1, 5))))


@register("A12_multi_reference_bleu", f"""WITH {_MULTI}, st AS (SELECT *, closest AS rl FROM (SELECT {_SUMS} FROM per))
SELECT round({_bleu_sql()}, 6) AS bleu, {", ".join(f"CAST(num_{k} AS BIGINT) AS num_{k}" for k in range(1, 5))},
  CAST(hl AS BIGINT) AS hyp_len, CAST(rl AS BIGINT) AS ref_len FROM st""")
def a12(spark, d):
    """B1 over one to three references a reply."""
    s = B.corpus_bleu(*A.reference_sets(spark, d, X.ws_tokens), KEY)
    return s.select(r6("bleu").alias("bleu"), "num_1", "num_2", "num_3", "num_4",
                    F.col("hyp_len").cast("long").alias("hyp_len"), F.col("ref_closest").cast("long").alias("ref_len"))


@register("B2_multi_reference", f"""WITH {_MULTI}, st AS (SELECT *, closest AS rl FROM per)
SELECT conv_id, turn, round({_bleu_sql()}, 6) AS bleu FROM st""")
def b2m(spark, d):
    return B.sentence_bleu(*A.reference_sets(spark, d, X.ws_tokens), KEY).select(*KEY, r6("bleu").alias("bleu"))


@register("B3_multi_reference", f"""WITH {_MULTI}, p AS (SELECT *, {", ".join(f"(num_{k}+1.0)/(g{k}+1) AS p{k}" for k in range(1, 5))},
  hl/shortest AS ratio FROM (SELECT {_SUMS} FROM per))
SELECT round(exp((ln(p1)+ln(p2)+ln(p3)+ln(p4))/4) * CASE WHEN ratio > 1 THEN 1.0 ELSE exp(1 - 1/ratio) END, 6) AS bleu,
  {", ".join(f"round(p{k}, 6) AS precision_{k}" for k in range(1, 5))}, round(ratio, 6) AS ratio,
  CAST(hl AS BIGINT) AS translation_length, CAST(shortest AS BIGINT) AS reference_length FROM p""")
def b3m(spark, d):
    s = B.nmt_bleu(*A.reference_sets(spark, d, X.ws_tokens), KEY, smooth=True)
    return s.select(*[r6(c).alias(c) for c in ("bleu", *(f"precision_{k}" for k in range(1, 5)), "ratio")],
                    "translation_length", "reference_length")


def _b4_multi_sql(length: str) -> str:
    logs = " + ".join(f"(ln(num_{k} + {min(k, 2) - 1} + {TINY}) - ln(g{k} + {min(k, 2) - 1} + {TINY}))" for k in range(1, 5))
    each = ", ".join(f"CASE WHEN g{k} = 0 THEN 0.0 ELSE exp(ln(num_{k} + {TINY}) - ln(g{k})) END AS b{k}" for k in range(1, 5))
    return f"""WITH {_MULTI_NIST}, b AS (SELECT exp(({logs}) / 4 + least(0, 1 - ({length} + 1) / (hl + 1))) AS b0, {each} FROM per)
SELECT round(avg(b0) * 100, 6) AS bleu, {", ".join(f"round(avg(b{k}) * 100, 6) AS bleu_{k}" for k in range(1, 5))} FROM b"""


def _b4_multi(spark, d, length):
    s = B.smoothed_pair_bleu(*A.reference_sets(spark, d, lambda c: _nist_tokens(c)), KEY, ref_length=length)
    return s.select(*[r6(c).alias(c) for c in ("bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4")])


@register("B4_shortest_reference", _b4_multi_sql("shortest"))
def b4_shortest(spark, d):
    return _b4_multi(spark, d, "shortest")


@register("B4_average_reference", _b4_multi_sql("average"))
def b4_average(spark, d):
    return _b4_multi(spark, d, "average")


@register("B4_closest_reference", _b4_multi_sql("first_closest"))
def b4_closest(spark, d):
    return _b4_multi(spark, d, "closest")


@register("B10_multi_reference", f"""WITH {_MULTI}, kw AS (SELECT * FROM (VALUES {KW}) v(g)),
w AS (SELECT rc.*, coalesce(hc.c, 0) AS h, CASE WHEN rc.n = 1 AND kw.g IS NULL THEN 0.2 ELSE 1.0 END AS w
  FROM rc LEFT JOIN hc USING (conv_id, turn, n, g) LEFT JOIN kw ON rc.g = kw.g),
pr AS (SELECT conv_id, turn, ref_no, n, sum(least(c, h) * w) AS num, greatest(1.0, sum(c * w)) AS den FROM w GROUP BY ALL),
al AS (SELECT o.n, coalesce(num, 0.0) AS num, coalesce(den, 1.0) AS den FROM rf CROSS JOIN ord o
  LEFT JOIN pr ON pr.conv_id = rf.conv_id AND pr.turn = rf.turn AND pr.ref_no = rf.ref_no AND pr.n = o.n),
s AS (SELECT {", ".join(f"sum(num) FILTER (WHERE n = {k}) AS num_{k}, sum(den) FILTER (WHERE n = {k}) AS d{k}" for k in range(1, 5))},
  (SELECT sum(hl) FROM per) AS hl, (SELECT sum(closest) FROM per) AS rl FROM al)
SELECT round({_bleu_sql()}, 6) AS bleu, {", ".join(f"CAST(round(num_{k}, 6) AS DOUBLE) AS num_{k}, CAST(round(d{k}, 6) AS DOUBLE) AS den_{k}" for k in range(1, 5))} FROM s""")
def b10m(spark, d):
    """B10 over several references, brevity by the closest true length."""
    s = B.weighted_recall_bleu(*A.reference_sets(spark, d, X.ws_tokens), KEY, brevity="true_length")
    return s.select(r6("bleu").alias("bleu"), *[r6(f"{p}_{k}").alias(f"{p}_{k}") for k in range(1, 5) for p in ("num", "den")])


# --- the other smoothing variants of B12 ------------------------------------------

TOK5 = TOK.replace("[1, 2, 3, 4]", "[1, 2, 3, 4, 5]")
_STATS5 = f"""ms AS (SELECT conv_id, turn, {", ".join(f"coalesce(sum(m) FILTER (WHERE n = {k}), 0) AS num_{k}" for k in range(1, 6))}
  FROM tok LEFT JOIN mp USING (conv_id, turn) GROUP BY ALL),
st AS (SELECT ms.*, len(ht) AS hl, len(rt) AS rl, {", ".join(f"greatest(1, len(ht)-{k - 1}) AS d{k}, greatest(0, len(ht)-{k - 1}) AS g{k}" for k in range(1, 6))}
  FROM ms JOIN tok USING (conv_id, turn))"""


def _mean_sql(p: list[str]) -> str:
    """Variant 5: each order's mean with the one before (averaged) and the one after."""
    names = [f"({x}) AS p{k}" for k, x in enumerate([*p, "num_5 / d5"], start=1)]
    steps = ["q AS (SELECT *, (p1 + 1 + p1 + p2) / 3 AS q1 FROM p0)"]
    steps += [f"q{k} AS (SELECT *, (q{k - 1} + p{k} + p{k + 1}) / 3 AS q{k} FROM {'q' if k == 2 else f'q{k - 1}'})" for k in (2, 3, 4)]
    return (f"WITH {Q.PAIRS}, {TOK5}, {_STATS5}, p0 AS (SELECT *, {', '.join(names)} FROM st), {', '.join(steps)} "
            f"SELECT conv_id, turn, round({_sent_sql([f'q{k}' for k in range(1, 5)])}, 6) AS bleu FROM q4")


def _b12(spark, d, smoothing, max_n=4):
    st = B.pair_stats(A.text_pairs(spark, d), KEY, "hyp", "ref", X.ws_tokens, max_n=max_n, by_pair=True)
    return B.bleu_from_stats(st, smoothing=smoothing).select(*KEY, r6("bleu").alias("bleu"))


@register("B12_sentence_method0", f"""WITH {Q.PAIRS}, {TOK}, {_stats_sql(True)}
SELECT conv_id, turn, round({_sent_sql([f"CASE WHEN num_{k} = 0 THEN {TINY} ELSE num_{k} / d{k} END" for k in range(1, 5)])}, 6) AS bleu
FROM st""")
def b12m0(spark, d):
    return _b12(spark, d, "method0")


@register("B12_sentence_method5", _mean_sql([f"num_{k} / d{k}" for k in range(1, 5)]))
def b12m5(spark, d):
    return _b12(spark, d, "method5", 5)


@register("B12_sentence_method6", f"""WITH {Q.PAIRS}, {TOK}, {_stats_sql(True)},
a AS (SELECT *, num_1 / d1 AS p1, num_2 / d2 AS p2 FROM st),
b AS (SELECT *, (num_3 + 5 * CASE WHEN p1 = 0 THEN 0 ELSE p2 * p2 / p1 END) / (g3 + 5) AS p3 FROM a),
c AS (SELECT *, (num_4 + 5 * CASE WHEN p2 = 0 THEN 0 ELSE p3 * p3 / p2 END) / (g4 + 5) AS p4 FROM b)
SELECT conv_id, turn, round(CASE WHEN num_1 = 0 THEN 0.0 WHEN num_3 = 0 THEN NULL
  ELSE {_sent_sql(["p1", "p2", "p3", "p4"])} END, 6) AS bleu FROM c""")
def b12m6(spark, d):
    return _b12(spark, d, "method6")


@register("B12_sentence_method7", _mean_sql(_M4))
def b12m7(spark, d):
    return _b12(spark, d, "method7", 5)
