"""Classification / regression metrics and metric-log aggregation
(A6-A8, A13, M1-M10, P8, P12, W8, W9).

Every metric is ``DataFrame -> one-row DataFrame`` built from hash
aggregates with partial (map-side) aggregation; NULL labels are the
padding mask (P8) and are skipped.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.operators.ordered import ordered_prefix_sum
from gradeframe.operators.sequence import unit_hash


def sigmoid(z) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return 1.0 / (1.0 + F.exp(-z))


def predict_label(logit, threshold: float = 0.5) -> Column:
    """``sigmoid(z) > threshold`` (strict) as 0/1."""
    return F.when(sigmoid(logit) > threshold, 1).otherwise(0)


def threshold_label(prob, threshold: float = 0.5) -> Column:
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(p > threshold, 1).otherwise(0)


def _valid(df: DataFrame, *cols: str) -> DataFrame:
    cond = None
    for c in cols:
        e = F.col(c).isNotNull()
        cond = e if cond is None else cond & e
    return df.where(cond)


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M3: TP FP FN TN over non-null (label, pred)."""
    d = _valid(df, label, pred)
    y, p = F.col(label) == 1, F.col(pred) == 1
    return d.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                 F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M1: share of non-null rows where pred equals label."""
    d = _valid(df, label, pred)
    return d.agg(F.avg(F.when(F.col(label) == F.col(pred), 1.0).otherwise(0.0)).alias("accuracy"))


def f1(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M2: 2TP / (2TP + FP + FN); 0 when the denominator is 0."""
    c = confusion(df, label, pred)
    tp = F.col("tp")
    return c.select(F.coalesce(F.try_divide((2 * tp).cast("double"),
                                            2 * tp + F.col("fp") + F.col("fn")),
                               F.lit(0.0)).alias("f1"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            ranges: int | None = None, by: list[str] | None = None) -> DataFrame:
    """M4: exact ROC AUC (Mann-Whitney, ties count one half), overall or per
    group of ``by``.

    Rows are first reduced to one row per (group, distinct score) with
    positive and negative counts (hash aggregate with map-side combine).
    The number of positives strictly above each score is a distributed
    prefix sum over the score order (see :func:`ordered_prefix_sum`; all
    groups are split into score ranges), so no single task or the driver ever
    sees all distinct scores.  NULL when a group has only one class.
    """
    by = list(by or [])
    d = _valid(df, label, score)
    s = d.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_neg"))
    s = ordered_prefix_sum(s, "_s", "_pos", "_above", by=by, descending=True,
                           inclusive=False, ranges=ranges)
    aggs = [F.sum("_pos").alias("P"), F.sum("_neg").alias("N"),
            F.sum(F.col("_neg") * (F.col("_above") + F.col("_pos") / 2.0)).alias("U")]
    tot = s.groupBy(*by).agg(*aggs) if by else s.agg(*aggs)
    return tot.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  F.col("U") / (F.col("P").cast("double") * F.col("N")))
                      .alias("auc"))


def roc_auc_histogram(df: DataFrame, label: str = "label", score: str = "score", bins: int = 1 << 16,
                      low: float | None = None, high: float | None = None) -> DataFrame:
    """M4 for very many distinct scores: (auc, bound) from counts of positives
    and negatives in ``bins`` equal bins between ``low`` and ``high`` (the
    least and greatest score unless given; scores beyond count at the ends).

    Counts of parts of the data add up, map-side like any sum, and at most
    ``bins`` rows are left to be put in order, whatever the input.  Pairs in
    different bins count exactly; those of one bin count one half, so the
    exact AUC lies within ``bound`` = sum(pos * neg) / (2 P N) over the bins.
    Both are null with one class only."""
    d = _valid(df, label, score).select((F.col(label) == 1).alias("_y"), F.col(score).cast("double").alias("_s"))
    if low is None or high is None:
        edge = d.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))                     # one row
    else:
        edge = df.sparkSession.createDataFrame([(float(low), float(high))], "_lo double, _hi double")
    share = F.coalesce(F.try_divide(F.col("_s") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(share * bins))).cast("int")
    counts = d.crossJoin(F.broadcast(edge)).groupBy(place.alias("_b")).agg(
        F.count_if("_y").alias("_pos"), F.count_if(~F.col("_y")).alias("_neg"))
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)       # bins rows at most
    c = counts.withColumn("_above", F.coalesce(F.sum("_pos").over(above), F.lit(0)))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    wins = F.sum(F.col("_neg").cast("double") * (F.col("_above") + F.col("_pos") / 2.0))
    return c.agg(F.when(pairs > 0, wins / pairs).alias("auc"),
                 F.when(pairs > 0, F.sum(F.col("_pos").cast("double") * F.col("_neg")) / 2 / pairs).alias("bound"))


def mse(df: DataFrame, a: str, b: str) -> DataFrame:
    """M5: mean squared difference of two score columns."""
    d = _valid(df, a, b)
    return d.agg(F.avg((F.col(a).cast("double") - F.col(b)) ** 2).alias("mse"))


def pass_rate_mse(df: DataFrame, key: str = "submission_id", label: str = "label",
                  pred: str = "pred") -> DataFrame:
    """M6: per submission, mean label minus mean predicted label, squared;
    averaged over submissions that have at least one valid test."""
    d = _valid(df, label, pred)
    per = d.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("_y"),
                             F.avg(F.col(pred).cast("double")).alias("_p"))
    return per.agg(F.avg((F.col("_y") - F.col("_p")) ** 2).alias("mse"),
                   F.count(F.lit(1)).alias("n_submissions"))


def bce_with_logits(df: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """Mean binary cross entropy on logits over non-null labels
    (numerically stable form)."""
    d = _valid(df, logit, label)
    z, y = F.col(logit).cast("double"), F.col(label).cast("double")
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return d.agg(F.avg(loss).alias("bce"))


def weighted_mean(df: DataFrame, x: str, w: str, by: list[str] | None = None) -> DataFrame:
    """sum(x*w) / sum(w); NULL where the weights sum to zero."""
    agg = F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(w)).alias("weighted_mean")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def aggregate_log(log: DataFrame, by: list[str] | None = None,
                  elements: DataFrame | None = None) -> DataFrame:
    """Per (epoch, split) summary of a training log.

    ``log`` holds one row per batch with a scalar ``loss``:
    ``loss_batch_mean`` is the unweighted mean over batches.  When the log
    carries ``acc_hits`` / ``acc_n`` they are pooled (sum / sum).
    ``elements`` (optional) holds one row per scored element with
    ``label``, ``logit`` and ``pred``: it adds ``acc`` pooled over elements,
    ``pred`` summed, and ``auc`` pooled over elements (M4 per group).
    """
    by = by or ["epoch", "split"]
    aggs = [F.avg("loss").alias("loss_batch_mean"), F.count(F.lit(1)).alias("batches")]
    if "acc_hits" in log.columns and "acc_n" in log.columns:
        aggs.append(F.try_divide(F.sum("acc_hits"), F.sum("acc_n")).alias("acc"))
    out = log.groupBy(*by).agg(*aggs)
    if elements is not None:
        e = _valid(elements, "label", "pred")
        ea = e.groupBy(*by).agg(
            F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)).alias("acc_elements"),
            F.sum("pred").alias("pred"))
        auc = roc_auc(elements, "label", "logit", by=by)
        out = out.join(ea, by, "left").join(auc, by, "left")
    return out


def best_epoch(summary: DataFrame, split_col: str = "split", valid: str = "valid",
               metric: str = "loss_batch_mean", report: dict[str, list[str]] | None = None) -> DataFrame:
    """The epoch with the smallest validation metric (first epoch
    wins ties), and ``report`` (split -> its metrics) at that epoch as columns
    ``<split>_<metric>`` (null where the split has no such epoch).

    One conditional aggregate: the summary is reduced to one row per epoch, of
    which the best is taken.
    """
    report = report or {}
    here = F.col(split_col)
    wanted = [F.max(F.when(here == s, F.col(m))).alias(f"{s}_{m}") for s, ms in report.items() for m in ms]
    epochs = summary.groupBy("epoch").agg(F.min(F.when(here == valid, F.col(metric))).alias("_v"), *wanted)
    names = [f"{s}_{m}" for s, ms in report.items() for m in ms]
    order = F.struct("_v", "epoch")
    best = epochs.where(F.col("_v").isNotNull()).agg(
        F.min_by(F.struct(F.col("epoch"), F.col("_v"), *[F.col(f"`{c}`") for c in names]), order).alias("_b"))
    return best.select(F.col("_b.epoch").alias("best_epoch"), F.col("_b._v").alias("best_valid"),
                       *[F.col(f"_b.`{c}`").alias(c) for c in names])


def running_best(summary: DataFrame, split_col: str = "split",
                 metric: str = "loss_batch_mean") -> DataFrame:
    """Per split, the best (minimum) metric seen up to each epoch.
    The window is partitioned by split; a log holds one row per epoch."""
    w = Window.partitionBy(split_col).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return summary.withColumn("running_best", F.min(metric).over(w))


def prefix_metrics(log: DataFrame, every: int, by: list[str] | None = None) -> DataFrame:
    """Cumulative mean loss after every ``every`` batches.

    The cumulative sums are a distributed prefix sum per (epoch, split)
    group ordered by batch, then rows with ``(batch + 1) % every == 0``.
    """
    by = by or ["epoch", "split"]
    # skew-safe running sum: a (epoch, split) group may hold most rows
    return (ordered_prefix_sum(log, "batch", "loss", "cum_loss", by=by)
               .where((F.col("batch") + 1) % every == 0)
               .select(*by, "batch", "cum_loss",
                       (F.col("cum_loss") / (F.col("batch") + 1)).alias("prefix_loss")))


def welch_t(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """M7: Welch's t statistic and degrees of freedom between groups a and b
    (NULL for groups of one row or without variance), with its two-sided p
    value (:func:`student_p`)."""
    s = df.where(F.col(group).isin(a, b)).groupBy().agg(
        *[f(F.when(F.col(group) == g, F.col(value).cast("double"))).alias(f"{n}_{i}")
          for i, g in enumerate((a, b))
          for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    va, vb = F.try_divide("v_0", "n_0"), F.try_divide("v_1", "n_1")
    t = F.try_divide(F.col("m_0") - F.col("m_1"), F.sqrt(va + vb))
    dof = F.try_divide((va + vb) ** 2, F.try_divide(va ** 2, F.col("n_0") - 1) + F.try_divide(vb ** 2, F.col("n_1") - 1))
    return s.select(t.alias("t"), dof.alias("df")).withColumn("p", student_p(F.col("t"), F.col("df")))


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p value of Student's t as a column: the regularised incomplete
    beta function I_x(dof/2, 1/2) at x = dof / (dof + t^2).

    Its continued fraction is folded step by step (more steps for more degrees
    of freedom), on the side where it converges fast; the ratio
    Gamma(a + 1/2) / Gamma(a) comes from its series at a + 50 and 50 factors.
    """
    a, b = dof / 2, F.lit(0.5)
    odds = t * t / dof                                              # (1 - x) / x
    x, rest = 1 / (1 + odds), odds / (1 + odds)
    far = a + 50
    series = F.log(far) / 2 - 1 / (8 * far) + 1 / (192 * far ** 3)
    ratio = F.aggregate(F.sequence(F.lit(0), F.lit(49)), series, lambda s, i: s + F.log((a + i) / (a + i + 0.5)))
    front = F.exp(-a * F.log1p(odds) + F.log(rest) / 2 + ratio - math.lgamma(0.5))
    steps = F.sequence(F.lit(1), F.ceil(100 + 6 * F.sqrt(a)).cast("int"))

    def fraction(p: Column, q: Column, z: Column) -> Column:
        def safe(v):
            return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

        def turn(s: Column, coefficient: Column) -> Column:
            d, c = 1 / safe(1 + coefficient * s["d"]), safe(1 + coefficient / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        def step(s: Column, m: Column) -> Column:
            m = m.cast("double")
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return F.transform(F.array(turn(s, even)), lambda u: turn(u, odd))[0]

        d = 1 / safe(1 - (p + q) * z / (p + 1))
        return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")), step)["h"]

    low = front * fraction(a, b, x) / a
    high = 1 - front * fraction(b, a, rest) / b
    value = F.when(x < (a + 1) / (a + b + 2), low).otherwise(high)
    return (F.when(t.isNull() | dof.isNull() | F.isnan(t) | F.isnan(dof), F.lit(None).cast("double"))
            .when(t == 0, F.lit(1.0)).when(F.abs(t) == float("inf"), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))))


def welch_p_value(t: float, dof: float) -> float:
    """Two-sided p value of Student's t.

    With phi = atan(sqrt(dof) / |t|) it is 2 / B(dof/2, 1/2) times the integral
    of sin(u)**(dof - 1) over 0..phi.  The integrand rises towards phi, so the
    range is halved towards there and each piece takes Gauss-Legendre points.
    """
    if t is None or dof is None or math.isnan(t) or math.isnan(dof):
        return float("nan")
    if t == 0:
        return 1.0
    if math.isinf(t):
        return 0.0
    phi = math.atan2(math.sqrt(dof), abs(t))
    node, weight = np.polynomial.legendre.leggauss(64)
    edge = np.r_[phi * (1 - 0.5 ** np.arange(52)), phi]
    half, mid = np.diff(edge) / 2, (edge[1:] + edge[:-1]) / 2
    u = mid[:, None] + half[:, None] * node
    area = (np.exp((dof - 1) * np.log(np.sin(u))) * weight * half[:, None]).sum()
    beta = math.lgamma(dof / 2) + math.lgamma(0.5) - math.lgamma((dof + 1) / 2)
    return min(1.0, 2 * area * math.exp(-beta))


def majority_baseline(df: DataFrame) -> DataFrame:
    """M9: constant prediction 1."""
    return df.withColumn("pred", F.lit(1))


def random_baseline(df: DataFrame, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """M9: seeded normal logits, thresholded at 0.5 after the sigmoid.

    Each draw is a function of the row's ``key`` (all columns, unless named)
    and the seed: Box-Muller over two portable hashes.  So it survives retries
    and any partitioning; equal keys get equal draws."""
    key = key or df.columns
    first = (unit_hash(key, 2 * seed) * (1 << 52) + 0.5) / (1 << 52)             # never 0
    draw = F.sqrt(-2 * F.log(first)) * F.cos(2 * math.pi * unit_hash(key, 2 * seed + 1))
    return df.withColumn("logit_rand", draw).withColumn(
        "pred", predict_label(F.col("logit_rand")))
