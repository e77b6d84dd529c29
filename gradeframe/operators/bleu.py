"""n-gram text metrics: corpus / sentence BLEU, shortest-reference BLEU,
smoothed per-pair BLEU, distinct-N and weighted n-gram recall
(B1-B5, B10, B12).

Plan shape
----------
The compact texts are hash-partitioned by pair key, into partitions that hold
a bounded amount of text (their number grows with it), tokenised per row (JVM
regex), exploded into (pair, n, gram) rows and counted where the pair is.
Hypothesis and reference counts meet in a union and an aggregate on
(pair, n, gram), not in a join; of several references the largest count
clips.  Per-pair lengths never leave the pair level.
All statistics end in one aggregate (per pair for sentence scores, global
for corpus scores) over a union of match rows and length rows, and the
score itself is a closed-form column expression on that row.  Whole texts
are used; nothing is sampled or truncated.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.functions.text import ngrams
from gradeframe.session import ensure_parallelism, partition_by_key, partitions_for

FLOAT_MIN = sys.float_info.min

# Text of both sides in one partition of pairs: its n-grams and their counts
# take about 1,000 bytes of a task's memory for each byte of text.
PARTITION_BYTES = 1 << 18

# Pairs of so much text are matched in their row: a gram that repeats costs a
# look at all the row's grams of its order, so a row's work is bounded by this.
IN_ROW_BYTES = 256

# Java keywords, weighted 1 (other unigrams 0.2) in B10.
JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do "
    "double else enum extends final finally float for goto if implements import instanceof "
    "int interface long native new package private protected public return short static "
    "strictfp super switch synchronized this throw throws transient try void volatile while"
).split()


def sides(pairs: DataFrame, key: list[str], hyp: str, ref: str, tokenize) -> tuple[DataFrame, DataFrame]:
    """(hyps, refs) from a pairs table with one reference per hypothesis:
    hyps (key, tokens), refs (key, ref_no, tokens)."""
    h = pairs.select(*key, tokenize(F.col(hyp)).alias("tokens"))
    r = pairs.select(*key, F.lit(0).alias("ref_no"), tokenize(F.col(ref)).alias("tokens"))
    return h, r


def gram_rows(df: DataFrame, cols: list[str], max_n: int, tokens: str = "tokens") -> DataFrame:
    """(cols, n, gram) for every n-gram of order 1..max_n (partitioning of
    ``df`` is kept: both explodes are narrow)."""
    return (df.select(*cols, tokens, F.explode(F.sequence(F.lit(1), F.lit(max_n))).alias("n"))
              .select(*cols, "n", F.explode(ngrams(F.col(tokens), F.col("n"))).alias("gram")))


def _counts(df, cols, max_n, name):
    return gram_rows(df, cols, max_n).groupBy(*cols, "n", "gram").agg(F.count(F.lit(1)).alias(name))


def _keyed(hyps: DataFrame, refs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides hash-partitioned by the pair key with the same partition
    count, so every later aggregate and the length join stay local."""
    return partition_by_key(hyps, key), partition_by_key(refs, key)


def _token_bytes() -> Column:
    return F.octet_length(F.array_join("tokens", " "))


def precision_matches(hyps: DataFrame, refs: DataFrame, key: list[str], max_n: int = 4) -> DataFrame:
    """(key, n, m): hypothesis n-gram counts clipped by the maximum count
    over the references (J9, A12).  The compact texts of both sides are put
    together before the one exchange, by pair key; n-grams are counted per
    text, then per pair, where the pair is: no join, no n-gram is shuffled."""
    texts = hyps.select(*key, F.lit(None).cast("int").alias("ref_no"), "tokens") \
        .unionByName(refs.select(*key, F.col("ref_no").cast("int").alias("ref_no"), "tokens"))
    texts = partition_by_key(texts, key, _token_bytes(), PARTITION_BYTES)
    c = _counts(texts, [*key, "ref_no"], max_n, "c")
    own = F.col("ref_no").isNull()
    g = c.groupBy(*key, "n", "gram").agg(F.max(F.when(own, F.col("c"))).alias("hc"), F.max(F.when(~own, F.col("c"))).alias("rc"))
    return g.where(F.col("hc").isNotNull() & F.col("rc").isNotNull()) \
        .select(*key, "n", F.least("hc", "rc").alias("m"))


def pair_lengths(hyps: DataFrame, refs: DataFrame, key: list[str]) -> DataFrame:
    """(key, hyp_len, ref_closest, ref_shortest, ref_first_closest, ref_avg)."""
    h, r = _keyed(hyps, refs, key)
    hl = h.select(*key, F.size("tokens").alias("hyp_len"))
    rl = r.select(*key, "ref_no", F.size("tokens").alias("rlen"))
    j = hl.join(rl, key)
    diff = F.abs(F.col("rlen") - F.col("hyp_len"))
    return j.groupBy(*key).agg(
        F.first("hyp_len").alias("hyp_len"),
        F.min_by("rlen", F.struct(diff, F.col("rlen"))).alias("ref_closest"),
        F.min("rlen").alias("ref_shortest"),
        F.min_by("rlen", F.struct(diff, F.col("ref_no"))).alias("ref_first_closest"),
        F.avg("rlen").alias("ref_avg"))


def _stats(matches: DataFrame, lengths: DataFrame, key: list[str], max_n: int,
           by_pair: bool) -> DataFrame:
    """One aggregate over the union of match rows and length rows."""
    m = matches.select(*key, "n", F.col("m").cast("long").alias("m"),
                       *[F.lit(None).cast("double").alias(c) for c in
                         ("hyp_len", "ref_closest", "ref_shortest", "ref_first_closest", "ref_avg")])
    l = lengths.select(*key, F.lit(0).alias("n"), F.lit(None).cast("long").alias("m"),
                       *[F.col(c).cast("double").alias(c) for c in
                         ("hyp_len", "ref_closest", "ref_shortest", "ref_first_closest", "ref_avg")])
    u = m.unionByName(l)
    hl = F.col("hyp_len")
    aggs = []
    for k in range(1, max_n + 1):
        aggs.append(F.coalesce(F.sum(F.when(F.col("n") == k, F.col("m"))), F.lit(0)).alias(f"num_{k}"))
        # greatest() skips NULLs: only length rows may contribute here
        aggs.append(F.sum(F.when(hl.isNotNull(), F.greatest(F.lit(1.0), hl - k + 1)))
                    .alias(f"den_{k}"))
        aggs.append(F.sum(F.when(hl.isNotNull(), F.greatest(F.lit(0.0), hl - k + 1)))
                    .alias(f"guess_{k}"))
    aggs += [F.sum(c).alias(c) for c in
             ("hyp_len", "ref_closest", "ref_shortest", "ref_first_closest", "ref_avg")]
    aggs.append(F.count(hl).alias("pairs"))
    return u.groupBy(*key).agg(*aggs) if by_pair else u.agg(*aggs)


def pair_gram_counts(pairs: DataFrame, key: list[str], hyp: str, ref: str, tokenize,
                     max_n: int = 4) -> DataFrame:
    """Single-reference fast path: (key, n, gram, hc, rc) in ONE pass.

    Pair rows are hash-partitioned by key once (the only shuffle of the
    statistics), so many that one's counts fit a task's memory; each row is tokenised once; both sides' n-grams (orders
    1..N) and one length row (n = 0: hc = hypothesis length, rc = reference
    length) are exploded together and counted by a hash aggregate that
    needs no further exchange.  The n-grams never cross the network.
    """
    # shuffle the compact pair rows by key once; every aggregation below is
    # keyed by a superset of the key and runs where the pair already is
    t = partition_by_key(pairs, key, _pair_bytes(hyp, ref), PARTITION_BYTES).select(
        *key, tokenize(F.col(hyp)).alias("_ht"), tokenize(F.col(ref)).alias("_rt"))
    return _gram_counts(t, key, max_n)


def _pair_bytes(hyp: str, ref: str) -> Column:
    return F.coalesce(F.octet_length(hyp), F.lit(0)) + F.coalesce(F.octet_length(ref), F.lit(0))


def _gram_counts(t: DataFrame, key: list[str], max_n: int) -> DataFrame:
    """:func:`pair_gram_counts` of tokens _ht, _rt that lie by key."""
    def side(col, h, r):
        per_n = F.transform(F.sequence(F.lit(1), F.lit(max_n)), lambda n: F.transform(
            ngrams(F.col(col), n), lambda g: F.struct(n.alias("n"), g.alias("g"),
                                                      F.lit(h).alias("h"), F.lit(r).alias("r"))))
        return F.flatten(per_n)

    lens = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("g"),
                            F.size("_ht").alias("h"), F.size("_rt").alias("r")))
    e = t.select(*key, F.explode(F.concat(lens, side("_ht", 1, 0), side("_rt", 0, 1))).alias("_e"))
    return e.groupBy(*key, F.col("_e.n").alias("n"), F.col("_e.g").alias("gram")).agg(
        F.sum("_e.h").alias("hc"), F.sum("_e.r").alias("rc"))


def _longer(grams: str, tokens: str, k: int) -> Column:
    """The n-grams of order k from those of order k - 1 and the tokens."""
    left = F.size(tokens) - k + 1
    return F.when(left >= 1, F.zip_with(F.slice(grams, F.lit(1), left), F.slice(tokens, F.lit(k), left),
                                        lambda a, b: F.concat(a, F.lit(" "), b))) \
        .otherwise(F.array().cast("array<string>"))


def _in_row_matches(t: DataFrame, key: list[str], max_n: int, keywords: list[str] | None) -> DataFrame:
    """The columns of :func:`pair_counts` for short texts, a row a pair: of the
    grams both sides have, the smaller count, without a row for each gram.
    Orders above one without a match are not looked at."""
    t = t.select(*key, F.size("_ht").alias("hl"), F.size("_rt").alias("rl"), F.coalesce("_rt", F.array().cast("array<string>")).alias("_r1"),
                 F.coalesce("_ht", F.array().cast("array<string>")).alias("_h1"))
    done = ["hl", "rl"]
    if keywords is not None:
        t = t.withColumn("rk", F.size(F.filter("_r1", lambda g: g.isin(keywords)))) \
             .withColumns({f"r_{k}": F.greatest(F.size("_r1") - k + 1, F.lit(0)) for k in range(1, max_n + 1)})
        done += ["rk", *[f"r_{k}" for k in range(1, max_n + 1)]]
    for k in range(1, max_n + 1):
        h, r, both = F.col("_h1"), F.col("_r1"), F.col("_both")
        if k > 1:
            more = F.col(f"m_{k - 1}") > 0
            t = t.withColumns({f"_{s}{k}": F.when(more, _longer(f"_{s}{k - 1}", f"_{s}1", k)) for s in "hr"})
            h, r = F.col(f"_h{k}"), F.col(f"_r{k}")
        t = t.withColumn("_both", F.array_intersect(h, r))

        def met(grams, h=h, r=r):
            once = (F.size(F.array_distinct(h)) == F.size(h)) | (F.size(F.array_distinct(r)) == F.size(r))
            counts = F.aggregate(grams, F.lit(0), lambda a, g: a + F.least(
                F.size(F.filter(h, lambda x: x == g)), F.size(F.filter(r, lambda x: x == g))))
            return F.when(F.coalesce(F.size(grams), F.lit(0)) == 0, 0).when(once, F.size(grams)).otherwise(counts)

        t = t.withColumn(f"m_{k}", met(both))
        done.append(f"m_{k}")
        if k == 1 and keywords is not None:
            t = t.withColumn("mk", met(F.filter(both, lambda g: g.isin(keywords))))
            done.append("mk")
    return t.select(*key, *[F.col(c).cast("long").alias(c) for c in done])


def pair_counts(pairs: DataFrame, key: list[str], hyp: str, ref: str, tokenize, max_n: int = 4,
                keywords: list[str] | None = None) -> DataFrame:
    """A row a pair key: hl and rl (tokens of both sides), m_1..m_N (clipped
    n-gram matches), and with ``keywords`` r_1..r_N (the reference's n-grams),
    mk and rk (the matches and the reference's tokens that are keywords).

    Pair rows are hash-partitioned by key once (the only shuffle of the
    statistics).  Where a key has one row and its texts are short
    (``IN_ROW_BYTES``), the matches are counted in the row; the others'
    n-grams are exploded and counted as rows (:func:`pair_gram_counts`).
    """
    t = pairs.select(*key, F.col(hyp).alias("_h"), F.col(ref).alias("_r"), _pair_bytes(hyp, ref).alias("_size"))
    t = partition_by_key(t, key, F.col("_size"), PARTITION_BYTES)
    t = t.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    short = (F.col("_rows") == 1) & (F.col("_size") <= IN_ROW_BYTES)

    def tokens(x):
        return x.select(*key, tokenize(F.col("_h")).alias("_ht"), tokenize(F.col("_r")).alias("_rt"))

    c = _gram_counts(tokens(t.where(~short)), key, max_n)
    n, gram = F.col("n"), F.col("gram")
    aggs = [F.max(F.when(n == 0, F.col("hc"))).alias("hl"), F.max(F.when(n == 0, F.col("rc"))).alias("rl")]
    aggs += [F.coalesce(F.sum(F.when(n == k, F.least("hc", "rc"))), F.lit(0)).alias(f"m_{k}") for k in range(1, max_n + 1)]
    if keywords is not None:
        word = (n == 1) & gram.isin(keywords)
        aggs += [F.coalesce(F.sum(F.when(n == k, F.col("rc"))), F.lit(0)).alias(f"r_{k}") for k in range(1, max_n + 1)]
        aggs += [F.coalesce(F.sum(F.when(word, F.least("hc", "rc"))), F.lit(0)).alias("mk"),
                 F.coalesce(F.sum(F.when(word, F.col("rc"))), F.lit(0)).alias("rk")]
    return c.groupBy(*key).agg(*aggs).unionByName(_in_row_matches(tokens(t.where(short)), key, max_n, keywords))


def pair_stats(pairs: DataFrame, key: list[str], hyp: str, ref: str, tokenize,
               max_n: int = 4, by_pair: bool = False) -> DataFrame:
    """BLEU statistics (same columns as the multi-reference path) for
    single-reference pairs, from :func:`pair_counts`."""
    c = pair_counts(pairs, key, hyp, ref, tokenize, max_n)
    hl, rl = F.col("hl").cast("double"), F.col("rl").cast("double")
    aggs = []
    for k in range(1, max_n + 1):
        aggs.append(F.coalesce(F.sum(f"m_{k}"), F.lit(0)).cast("long").alias(f"num_{k}"))
        aggs.append(F.sum(F.greatest(F.lit(1.0), hl - k + 1)).alias(f"den_{k}"))
        aggs.append(F.sum(F.greatest(F.lit(0.0), hl - k + 1)).alias(f"guess_{k}"))
    aggs += [F.sum(hl).alias("hyp_len")] + [F.sum(rl).alias(c_) for c_ in
                                            ("ref_closest", "ref_shortest", "ref_first_closest", "ref_avg")]
    aggs.append(F.count(hl).alias("pairs"))
    return c.groupBy(*key).agg(*aggs) if by_pair else c.agg(*aggs)


def weighted_pair_stats(pairs: DataFrame, key: list[str], hyp: str, ref: str, tokenize,
                        keywords: list[str] | None = None, max_n: int = 4,
                        keyword_weight: float = 1.0, other_weight: float = 0.2) -> DataFrame:
    """B10 statistics for single-reference pairs from :func:`pair_counts`;
    keyword weights are an ``isin`` on a fixed list (no join)."""
    keywords = JAVA_KEYWORDS if keywords is None else keywords
    c = pair_counts(pairs, key, hyp, ref, tokenize, max_n, keywords)
    rl = F.col("rl")
    kw, kr = F.col("mk"), F.col("rk")
    aggs = []
    for k in range(1, max_n + 1):
        num, rsum = F.col(f"m_{k}").cast("double"), F.col(f"r_{k}").cast("double")
        if k == 1:
            num = kw * keyword_weight + (F.col("m_1") - kw) * other_weight
            rsum = kr * keyword_weight + (F.col("r_1") - kr) * other_weight
        aggs.append(F.coalesce(F.sum(num), F.lit(0.0)).alias(f"num_{k}"))
        # a reference with no order-k n-gram still adds a denominator of 1
        aggs.append((F.coalesce(F.sum(F.when(rsum > 0, F.greatest(F.lit(1.0), rsum))), F.lit(0.0))
                     + F.count_if(rl < k)).alias(f"den_{k}"))
    aggs += [F.sum("hl").cast("double").alias("hyp_len"),
             F.sum("rl").cast("double").alias("ref_closest"),
             F.count(F.lit(1)).cast("double").alias("pairs")]
    return c.agg(*aggs)


def bleu_from_stats(st: DataFrame, max_n: int = 4, weights=None, smoothing: str = "method1",
                    epsilon: float = 0.1, auto_reweigh: bool = False,
                    ref_len: str = "ref_closest") -> DataFrame:
    """B1 / B2 / B12 score columns on a statistics table."""
    return st.withColumn("bleu", _score(max_n, weights, smoothing, epsilon, auto_reweigh, ref_len)) \
             .withColumn("brevity", _brevity(F.col("hyp_len"), F.col(ref_len)))


def weighted_bleu_from_stats(st: DataFrame, max_n: int = 4, smoothing: str = "method1",
                             epsilon: float = 0.1, brevity: str = "reference_compatible") -> DataFrame:
    """B10 score on :func:`weighted_pair_stats` (D25 brevity choice)."""
    ref_len = (F.col("pairs") * 2.0) if brevity == "reference_compatible" else F.col("ref_closest")
    st = st.withColumn("_ref_len", ref_len)
    return st.withColumn("bleu", _score(max_n, None, smoothing, epsilon, False, "_ref_len")) \
             .drop("_ref_len")


def _smoothed(max_n: int, smoothing: str, epsilon: float, k: float = 5.0,
              alpha: float = 5.0) -> list[Column]:
    """Precision columns p_1..p_N after a smoothing variant.

    method0 none, 1 epsilon, 2 add-one, 3 NIST geometric, 4 length-scaled
    (k), 5 neighbour mean (needs order N+1 statistics), 6 interpolated
    (alpha), 7 = 4 then 5.  Variants 5-7 are defined per row.
    """
    num = [F.col(f"num_{i}").cast("double") for i in range(1, max_n + 2)]
    den = [F.col(f"den_{i}") for i in range(1, max_n + 2)]
    guess = [F.col(f"guess_{i}") for i in range(1, max_n + 2)]
    hl = F.col("hyp_len")
    plain = [a / b for a, b in zip(num, den)]
    out = []
    if smoothing == "method0":
        for a, b in zip(num[:max_n], den):
            out.append(F.when(a != 0, a / b).otherwise(F.lit(FLOAT_MIN)))
    elif smoothing == "method1":
        for a, b in zip(num[:max_n], den):
            out.append(F.when(a == 0, (a + epsilon) / b).otherwise(a / b))
    elif smoothing == "method2":
        for a, b in zip(num[:max_n], den):
            out.append((a + 1) / (b + 1))
    elif smoothing == "method3":
        zeros = F.lit(0)
        for a, b in zip(num[:max_n], den):
            zeros = zeros + F.when(a == 0, 1).otherwise(0)
            out.append(F.when(a == 0, 1.0 / (F.pow(F.lit(2.0), zeros) * b)).otherwise(a / b))
    elif smoothing in ("method4", "method7"):
        for i, (a, b) in enumerate(zip(num[:max_n], den)):
            # undefined (NULL) for a one-token hypothesis: ln(1) = 0
            inc = F.lit(float(i)) + F.try_divide(F.lit(k), F.log(hl))
            out.append(F.when((a == 0) & (hl != 0), inc / b).otherwise(a / b))
        if smoothing == "method7":
            out = _neighbour_mean(out, plain[max_n])
    elif smoothing == "method5":
        out = _neighbour_mean(plain[:max_n], plain[max_n])
    elif smoothing == "method6":
        out = list(plain[:2])
        for i in range(2, max_n):
            pi0 = F.when(out[i - 2] == 0, F.lit(0.0)).otherwise(out[i - 1] * out[i - 1] / out[i - 2])
            out.append((num[i] + alpha * pi0) / (guess[i] + alpha))
        # the variant requires a non-zero trigram precision
        out = [F.when(num[2] != 0, p) for p in out]
    else:
        raise ValueError(f"unknown smoothing {smoothing!r}")
    return out


def _neighbour_mean(p: list[Column], p_next: Column) -> list[Column]:
    """method5 core: p_i <- (m_{i-1} + p_i + p_{i+1}) / 3, m_{-1} = p_1 + 1,
    with p_{i+1} the unsmoothed input (order N+1 for the last)."""
    ext = list(p) + [p_next]
    prev = p[0] + 1
    out = []
    for i in range(len(p)):
        cur = (prev + p[i] + ext[i + 1]) / 3
        out.append(cur)
        prev = cur
    return out


def _brevity(hyp_len: Column, ref_len: Column) -> Column:
    return (F.when(hyp_len > ref_len, F.lit(1.0)).when(hyp_len == 0, F.lit(0.0))
             .otherwise(F.exp(1 - ref_len / hyp_len)))


def _score(max_n: int, weights, smoothing: str, epsilon: float, auto_reweigh: bool,
           ref_len: str) -> Column:
    weights = list(weights or [1.0 / max_n] * max_n)
    p = _smoothed(max_n, smoothing, epsilon)[:max_n]
    hl = F.col("hyp_len")
    terms = []
    for k, (w, pk) in enumerate(zip(weights, p), start=1):
        wk = F.lit(w)
        if auto_reweigh and weights == [0.25] * 4:
            wk = F.when(hl < 4, F.when(F.lit(k) <= hl, 1.0 / hl).otherwise(0.0)).otherwise(w)
        terms.append(F.when(wk == 0, F.lit(0.0)).otherwise(wk * F.log(pk)))
    s = terms[0]
    for t in terms[1:]:
        s = s + t
    bp = _brevity(hl, F.col(ref_len))
    return F.when(F.col("num_1") == 0, F.lit(0.0)).otherwise(bp * F.exp(s))


def corpus_bleu(hyps: DataFrame, refs: DataFrame, key: list[str], max_n: int = 4,
                weights=None, smoothing: str = "method1", epsilon: float = 0.1,
                auto_reweigh: bool = False) -> DataFrame:
    """B1: micro-averaged corpus BLEU (clip by max over references; each
    pair's denominator at least 1; closest reference length, ties shorter;
    no unigram match -> 0).  One row: bleu, the statistics and brevity."""
    if smoothing in ("method5", "method6", "method7"):
        raise ValueError("smoothing methods 5-7 are defined per row: use sentence_bleu")
    st = _stats(precision_matches(hyps, refs, key, max_n), pair_lengths(hyps, refs, key),
                key, max_n, by_pair=False)
    return st.withColumn("bleu", _score(max_n, weights, smoothing, epsilon, auto_reweigh,
                                        "ref_closest")) \
             .withColumn("brevity", _brevity(F.col("hyp_len"), F.col("ref_closest")))


def sentence_bleu(hyps: DataFrame, refs: DataFrame, key: list[str], max_n: int = 4,
                  weights=None, smoothing: str = "method1", epsilon: float = 0.1,
                  auto_reweigh: bool = False) -> DataFrame:
    """B2: BLEU of every pair on its own (B1 with the pair as group key)."""
    # variants 5 and 7 look one order further
    top = max_n + 1 if smoothing in ("method5", "method7") else max_n
    st = _stats(precision_matches(hyps, refs, key, top), pair_lengths(hyps, refs, key),
                key, top, by_pair=True)
    return st.withColumn("bleu", _score(max_n, weights, smoothing, epsilon, auto_reweigh,
                                        "ref_closest"))


def nmt_bleu(hyps: DataFrame, refs: DataFrame, key: list[str], max_n: int = 4,
             smooth: bool = False) -> DataFrame:
    """B3 over hypothesis / multi-reference tables (see
    :func:`nmt_bleu_from_stats`)."""
    st = _stats(precision_matches(hyps, refs, key, max_n), pair_lengths(hyps, refs, key),
                key, max_n, by_pair=False)
    return nmt_bleu_from_stats(st, max_n, smooth)


def nmt_bleu_from_stats(st: DataFrame, max_n: int = 4, smooth: bool = False) -> DataFrame:
    """BLEU with the shortest reference length; optional add-one
    smoothing on every order; else 0 when any order has no match.  One row:
    bleu, precision_1..N, bp, ratio, translation_length, reference_length."""
    prec = []
    for k in range(1, max_n + 1):
        m, g = F.col(f"num_{k}").cast("double"), F.col(f"guess_{k}")
        prec.append(((m + 1) / (g + 1)) if smooth
                    else F.when(g > 0, m / g).otherwise(F.lit(0.0)))
    positive = prec[0] > 0
    logs = F.log(prec[0]) / max_n
    for p in prec[1:]:
        positive = positive & (p > 0)
        logs = logs + F.log(p) / max_n
    geo = F.when(positive, F.exp(logs)).otherwise(F.lit(0.0))
    ratio = F.try_divide(F.col("hyp_len"), F.col("ref_shortest"))
    bp = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1 - 1 / ratio))
    return st.select((geo * bp).alias("bleu"),
                     *[p.alias(f"precision_{k}") for k, p in enumerate(prec, start=1)],
                     bp.alias("bp"), ratio.alias("ratio"),
                     F.col("hyp_len").cast("long").alias("translation_length"),
                     F.col("ref_shortest").cast("long").alias("reference_length"))


def smoothed_pair_bleu(hyps: DataFrame, refs: DataFrame, key: list[str], max_n: int = 4,
                       ref_length: str = "shortest") -> DataFrame:
    """B4 over hypothesis / multi-reference tables (see
    :func:`smoothed_from_stats`)."""
    st = _stats(precision_matches(hyps, refs, key, max_n), pair_lengths(hyps, refs, key),
                key, max_n, by_pair=True)
    return smoothed_from_stats(st, key, max_n, ref_length)


def smoothed_from_stats(st: DataFrame, key: list[str], max_n: int = 4,
                        ref_length: str = "shortest") -> DataFrame:
    """Per pair (``st`` holds per-pair statistics), add-one smoothing on
    orders above 1, brevity ``min(0, 1 - (r+1)/(h+1))`` in log space, then
    the mean over pairs x 100 of five numbers: overall and each order's
    plain precision.  Inputs are normalised token arrays (X17 / X18)."""
    rl = {"shortest": "ref_shortest", "average": "ref_avg",
          "closest": "ref_first_closest"}[ref_length]
    lb = None
    parts = []
    for k in range(1, max_n + 1):
        c, g = F.col(f"num_{k}").cast("double"), F.col(f"guess_{k}")
        add = 0.0 if k == 1 else 1.0
        t = F.log(c + add + FLOAT_MIN) - F.log(g + add + FLOAT_MIN)
        lb = t if lb is None else lb + t
        parts.append(F.when(g == 0, F.lit(-10000000.0)).otherwise(F.log(c + FLOAT_MIN) - F.log(g)))
    bp = F.least(F.lit(0.0), 1 - (F.col(rl) + 1) / (F.col("hyp_len") + 1))
    per = st.select(*key, F.exp(lb / max_n + bp).alias("b0"),
                    *[F.exp(p).alias(f"b{k}") for k, p in enumerate(parts, start=1)])
    return per.agg(*[(F.avg(f"b{k}") * 100.0).alias(f"bleu_{k}" if k else "bleu")
                     for k in range(0, max_n + 1)])


def weighted_recall_bleu(hyps: DataFrame, refs: DataFrame, key: list[str],
                         keywords: list[str] | None = None, max_n: int = 4,
                         keyword_weight: float = 1.0, other_weight: float = 0.2,
                         smoothing: str = "method1", epsilon: float = 0.1,
                         brevity: str = "reference_compatible") -> DataFrame:
    """Weighted n-gram *recall* BLEU over hypotheses and (several)
    references per pair.

    For every reference: clip its n-gram counts by the hypothesis counts;
    unigrams weigh ``keyword_weight`` for keywords and ``other_weight``
    otherwise; the reference's denominator is at least 1.  Numerators and
    denominators are summed over all (pair, reference).  ``brevity``:
    ``reference_compatible`` takes the reference length as 2 per pair (the
    length of the [tokens, weights] entry, D25); ``true_length`` uses the
    closest true reference length.

    Plan: both sides are hash-partitioned by pair key; hypothesis counts and
    per-reference counts meet in one local aggregate per (pair, n, gram)
    (the per-gram reference list is bounded by the pair's references), so
    nothing after the key partitioning shuffles except the one-row total.
    """
    keywords = JAVA_KEYWORDS if keywords is None else keywords
    n_parts = partitions_for(hyps.select("tokens").unionByName(refs.select("tokens")), _token_bytes(), PARTITION_BYTES)
    h, r = hyps.repartition(n_parts, *key), refs.repartition(n_parts, *key)
    hc = _counts(h, key, max_n, "hc").select(*key, "n", "gram", "hc",
                                             F.lit(None).cast("int").alias("ref_no"),
                                             F.lit(None).cast("long").alias("rc"))
    rc = _counts(r, key + ["ref_no"], max_n, "rc").select(
        *key, "n", "gram", F.lit(None).cast("long").alias("hc"), F.col("ref_no").cast("int"), "rc")
    g = hc.unionByName(rc).groupBy(*key, "n", "gram").agg(
        F.max("hc").alias("hc"),
        F.collect_list(F.when(F.col("ref_no").isNotNull(), F.struct("ref_no", "rc"))).alias("_refs"))
    e = g.select(*key, "n", "gram", F.coalesce("hc", F.lit(0)).alias("hc"),
                 F.explode("_refs").alias("_r")).select(*key, "n", "gram", "hc", "_r.ref_no", "_r.rc")
    n = F.col("n")
    w = F.when(n == 1, F.when(F.col("gram").isin(keywords), F.lit(keyword_weight))
               .otherwise(F.lit(other_weight))).otherwise(F.lit(1.0))
    per_ref = e.groupBy(*key, "ref_no", "n").agg(
        F.sum(F.least("rc", "hc") * w).alias("_num"), F.sum(F.col("rc") * w).alias("_rsum"))
    rows = per_ref.select("n", "_num", F.greatest(F.lit(1.0), F.col("_rsum")).alias("_den"))
    # a reference without any order-k n-gram still adds a denominator of 1
    rlen = refs.select(F.size("tokens").alias("_len"))
    for k in range(1, max_n + 1):
        rows = rows.unionByName(rlen.where(F.col("_len") < k).select(
            F.lit(k).alias("n"), F.lit(0.0).alias("_num"), F.lit(1.0).alias("_den")))
    lens = pair_lengths(hyps, refs, key)
    nd = rows.select("n", "_num", "_den", *[F.lit(None).cast("double").alias(c)
                                             for c in ("hyp_len", "ref_closest", "npairs")])
    ln = lens.select(F.lit(0).alias("n"), F.lit(None).cast("double").alias("_num"),
                     F.lit(None).cast("double").alias("_den"),
                     F.col("hyp_len").cast("double"), F.col("ref_closest").cast("double"),
                     F.lit(1.0).alias("npairs"))
    u = nd.unionByName(ln)
    aggs = []
    for k in range(1, max_n + 1):
        aggs.append(F.coalesce(F.sum(F.when(F.col("n") == k, F.col("_num"))), F.lit(0.0)).alias(f"num_{k}"))
        aggs.append(F.sum(F.when(F.col("n") == k, F.col("_den"))).alias(f"den_{k}"))
    aggs += [F.sum("hyp_len").alias("hyp_len"), F.sum("ref_closest").alias("ref_closest"),
             F.sum("npairs").alias("pairs")]
    return weighted_bleu_from_stats(u.agg(*aggs), max_n, smoothing, epsilon, brevity)


def distinct_n(texts: DataFrame, text: str, n: int, tokenize) -> DataFrame:
    """Per text, distinct n-grams / token count (0 for an empty text,
    which still counts), averaged over all texts.  Per-row hash-set work
    (``array_distinct`` on string n-grams), one global average."""
    return distinct_ns(texts, text, [n], tokenize)


def distinct_ns(texts: DataFrame, text: str, orders: list[int], tokenize) -> DataFrame:
    """B5 for several orders over one scan; tokens are materialised once
    per row (a column), never re-derived inside the n-gram lambda."""
    tok = ensure_parallelism(texts).select(tokenize(F.col(text)).alias("_t"))
    t = F.col("_t")
    aggs = []
    for n in orders:
        per = F.when(F.size(t) > 0, F.size(F.array_distinct(ngrams(t, n))) / F.size(t)) \
            .otherwise(F.lit(0.0))
        aggs.append(F.avg(per).alias(f"distinct_{n}"))
    return tok.agg(*aggs)
