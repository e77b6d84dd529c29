"""Registered metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.operators import metrics as M
from gradeframe.plans import adapters as A
from gradeframe.plans import sqlbase as Q
from gradeframe.plans.catalog import r6, register


def _pred(spark, d):
    return A.predictions(spark, d).withColumn("pred", M.threshold_label("prob"))


@register("M1_accuracy", f"""WITH {Q.PRED}
SELECT round(avg(CASE WHEN (CASE WHEN prob > 0.5 THEN 1 ELSE 0 END) = label
  THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END),6) AS accuracy FROM pred""")
def m1(spark, d):
    return M.accuracy(_pred(spark, d)).select(r6("accuracy").alias("accuracy"))


@register("M2_f1", f"""WITH {Q.PRED}, c AS (SELECT
  count(*) FILTER (WHERE label=1 AND prob>0.5) tp,
  count(*) FILTER (WHERE label=0 AND prob>0.5) fp,
  count(*) FILTER (WHERE label=1 AND NOT prob>0.5) fn FROM pred)
SELECT round(coalesce(CAST(2*tp AS DOUBLE)/nullif(2*tp+fp+fn,0),0),6) AS f1 FROM c""")
def m2(spark, d):
    return M.f1(_pred(spark, d)).select(r6("f1").alias("f1"))


@register("M3_confusion", f"""WITH {Q.PRED}
SELECT count(*) FILTER (WHERE label=1 AND prob>0.5) AS tp,
  count(*) FILTER (WHERE label=0 AND prob>0.5) AS fp,
  count(*) FILTER (WHERE label=1 AND NOT prob>0.5) AS fn,
  count(*) FILTER (WHERE label=0 AND NOT prob>0.5) AS tn FROM pred""")
def m3(spark, d):
    return M.confusion(_pred(spark, d))


@register("M4_roc_auc", f"""WITH {Q.PRED},
s AS (SELECT CAST(prob AS DOUBLE) s, sum(label) pos, sum(1-label) neg FROM pred GROUP BY 1),
c AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING
   AND 1 PRECEDING),0) above FROM s)
SELECT round(sum(neg*(above+pos/2.0))/(sum(pos)*CAST(sum(neg) AS DOUBLE)),6) AS auc FROM c""")
def m4(spark, d):
    return M.roc_auc(A.predictions(spark, d), "label", "prob").select(r6("auc").alias("auc"))


@register("M5_mse", f"""WITH {Q.PRED}
SELECT round(avg((CAST(label AS DOUBLE)-prob)*(CAST(label AS DOUBLE)-prob)),6) AS mse FROM pred""")
def m5(spark, d):
    return M.mse(A.predictions(spark, d), "label", "prob").select(r6("mse").alias("mse"))


@register("M6_pass_rate_mse", f"""WITH {Q.PRED},
p AS (SELECT submission_id, avg(CAST(label AS DOUBLE)) y,
  avg(CAST(CASE WHEN prob>0.5 THEN 1 ELSE 0 END AS DOUBLE)) p FROM pred GROUP BY 1)
SELECT round(avg((y-p)*(y-p)),6) AS mse, count(*) AS n_submissions FROM p""")
def m6(spark, d):
    r = M.pass_rate_mse(_pred(spark, d))
    return r.select(r6("mse").alias("mse"), "n_submissions")


@register("A8_bce_with_logits", f"""WITH {Q.PRED}
SELECT round(avg(greatest(logit,0) - logit*label + ln(1+exp(-abs(logit)))),6) AS bce FROM pred""")
def a8(spark, d):
    return M.bce_with_logits(A.predictions(spark, d)).select(r6("bce").alias("bce"))


@register("P12_predict_label", f"""WITH {Q.PRED}
SELECT CASE WHEN 1/(1+exp(-logit)) > 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS cnt
FROM pred GROUP BY 1""")
def p12(spark, d):
    p = A.predictions(spark, d).select(M.predict_label("logit").alias("pred"))
    return p.groupBy("pred").agg(F.count(F.lit(1)).alias("cnt"))


@register("A7_weighted_mean", f"""WITH {Q.PRED}
SELECT label, round(sum(prob*test_no)/sum(test_no),6) AS weighted_mean FROM pred GROUP BY label""")
def a7(spark, d):
    r = M.weighted_mean(A.predictions(spark, d), "prob", "test_no", by=["label"])
    return r.select("label", r6("weighted_mean").alias("weighted_mean"))


_LOG = """log AS (SELECT CAST(o_orderkey % 10 AS BIGINT) AS epoch, o_orderpriority AS split,
  CAST(row_number() OVER (PARTITION BY o_orderkey % 10, o_orderpriority ORDER BY o_orderkey) - 1
   AS BIGINT) AS batch, o_totalprice / 100000 AS loss FROM orders)"""


@register("A6_aggregate_log", f"""WITH {_LOG}
SELECT epoch, split, round(avg(loss),6) AS loss_batch_mean, count(*) AS batches
FROM log GROUP BY 1, 2""")
def a6(spark, d):
    r = M.aggregate_log(A.metric_log(spark, d))
    return r.select("epoch", "split", r6("loss_batch_mean").alias("loss_batch_mean"), "batches")


@register("W8_best_epoch", f"""WITH {_LOG},
s AS (SELECT epoch, split, avg(loss) m FROM log GROUP BY 1, 2)
SELECT arg_min(epoch, (m, epoch)) AS best_epoch, round(min(m),6) AS best_valid
FROM s WHERE split = '3-MEDIUM'""")
def w8(spark, d):
    s = M.aggregate_log(A.metric_log(spark, d))
    b = M.best_epoch(s, valid="3-MEDIUM")
    return b.select("best_epoch", r6("best_valid").alias("best_valid"))


@register("W8_running_best", f"""WITH {_LOG},
s AS (SELECT epoch, split, avg(loss) m FROM log GROUP BY 1, 2)
SELECT epoch, split, round(min(m) OVER (PARTITION BY split ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),6) AS running_best FROM s""")
def w8r(spark, d):
    s = M.running_best(M.aggregate_log(A.metric_log(spark, d)))
    return s.select("epoch", "split", r6("running_best").alias("running_best"))


@register("W9_prefix_metrics", f"""WITH {_LOG},
c AS (SELECT epoch, split, batch, sum(CAST(loss AS DECIMAL(20,7))) OVER (PARTITION BY epoch, split
  ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) cl FROM log)
SELECT epoch, split, batch, CAST(cl AS DOUBLE) AS cum_loss FROM c WHERE (batch+1) % 50 = 0""")
def w9(spark, d):
    # losses as exact decimals: the running sum is then exact in any order
    log = A.metric_log(spark, d).withColumn("loss", F.col("loss").cast("decimal(20,7)"))
    r = M.prefix_metrics(log, every=50)
    return r.select("epoch", "split", "batch", F.col("cum_loss").cast("double").alias("cum_loss"))


@register("M7_welch_t", f"""WITH {Q.PRED},
s AS (SELECT avg(prob) FILTER (WHERE label=0) m0, var_samp(prob) FILTER (WHERE label=0) v0,
  count(prob) FILTER (WHERE label=0) n0, avg(prob) FILTER (WHERE label=1) m1,
  var_samp(prob) FILTER (WHERE label=1) v1, count(prob) FILTER (WHERE label=1) n1 FROM pred)
SELECT round((m0-m1)/sqrt(v0/n0+v1/n1),6) AS t,
  round((v0/n0+v1/n1)*(v0/n0+v1/n1)/((v0/n0)*(v0/n0)/(n0-1)+(v1/n1)*(v1/n1)/(n1-1)),6) AS df
FROM s""")
def m7(spark, d):
    r = M.welch_t(A.predictions(spark, d), "prob", "label", 0, 1)
    return r.select(r6("t").alias("t"), r6("df").alias("df"))


@register("M7_welch_p", f"""WITH {Q.PRED},
s AS (SELECT avg(prob) FILTER (WHERE label=0) m0, var_samp(prob) FILTER (WHERE label=0) v0,
  count(prob) FILTER (WHERE label=0) n0, avg(prob) FILTER (WHERE label=1) m1,
  var_samp(prob) FILTER (WHERE label=1) v1, count(prob) FILTER (WHERE label=1) n1 FROM pred),
r AS (SELECT (m0-m1)/sqrt(v0/n0+v1/n1) AS t,
  (v0/n0+v1/n1)*(v0/n0+v1/n1)/((v0/n0)*(v0/n0)/(n0-1)+(v1/n1)*(v1/n1)/(n1-1)) AS df FROM s),
g AS (SELECT t, df, atan2(sqrt(df), abs(t)) AS phi, greatest(0, atan2(sqrt(df), abs(t)) - 40 / sqrt(df)) AS lo FROM r)
SELECT round(any_value(t), 6) AS t, round(any_value(df), 6) AS df, round(least(1, 2 * any_value(exp(lgamma((df+1)/2)
  - lgamma(df/2) - lgamma(0.5))) * any_value((phi - lo) / 60000) * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * pow(sin(lo + i * (phi - lo) / 20000), df - 1))), 6) AS p FROM g, range(20001) u(i)""")
def m7p(spark, d):
    """M7 with the p value; the oracle integrates the density by Simpson's rule."""
    r = M.welch_t(A.predictions(spark, d), "prob", "label", 0, 1)
    return r.select(r6("t").alias("t"), r6("df").alias("df"), r6("p").alias("p"))


@register("M4_auc_histogram", """WITH x AS (SELECT l_extendedprice AS s, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y FROM lineitem),
e AS (SELECT min(s) AS lo, max(s) AS hi FROM x),
b AS (SELECT greatest(0, least(1023, floor((s - lo) / (hi - lo) * 1024))) AS b, sum(y) AS p, sum(1 - y) AS n FROM x, e GROUP BY 1),
c AS (SELECT *, coalesce(sum(p) OVER (ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM b)
SELECT round(sum(n * (above + p / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS auc,
  round(CAST(sum(p * n) AS DOUBLE) / 2 / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS bound, TRUE AS within FROM c""")
def m4_histogram(spark, d):
    """M4 over prices, nearly all distinct, in 1,024 bins; the exact AUC is
    within the bound."""
    x = A.load(spark, d, "lineitem").select(F.col("l_extendedprice").alias("score"),
                                            F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"))
    sketch = M.roc_auc_histogram(x, bins=1024)
    both = sketch.crossJoin(M.roc_auc(x).select(F.col("auc").alias("exact")))                # two rows of one
    return both.select(r6("auc").alias("auc"), r6("bound").alias("bound"),
                       (F.abs(F.col("exact") - F.col("auc")) <= F.col("bound") + 1e-12).alias("within"))


@register("W8_best_epoch_report", f"""WITH {_LOG},
s AS (SELECT epoch, split, avg(loss) m, count(*) n FROM log GROUP BY 1, 2),
b AS (SELECT arg_min(epoch, (m, epoch)) AS e, min(m) AS m FROM s WHERE split = '3-MEDIUM')
SELECT b.e AS best_epoch, round(b.m, 6) AS best_valid, (SELECT round(m, 6) FROM s WHERE epoch = b.e AND split = '1-URGENT') AS test_loss,
  (SELECT n FROM s WHERE epoch = b.e AND split = '1-URGENT') AS test_batches,
  (SELECT round(m, 6) FROM s WHERE epoch = b.e AND split = '5-LOW') AS train_loss FROM b""")
def w8_report(spark, d):
    """Other splits' metrics at the epoch that is best in validation."""
    b = M.best_epoch(M.aggregate_log(A.metric_log(spark, d)), valid="3-MEDIUM",
                     report={"1-URGENT": ["loss_batch_mean", "batches"], "5-LOW": ["loss_batch_mean"]})
    return b.select("best_epoch", r6("best_valid").alias("best_valid"), r6(F.col("`1-URGENT_loss_batch_mean`")).alias("test_loss"),
                    F.col("`1-URGENT_batches`").alias("test_batches"), r6(F.col("`5-LOW_loss_batch_mean`")).alias("train_loss"))


@register("P8_padding_mask", f"""WITH {Q.PRED},
pad AS (SELECT submission_id, test_no, label, prob FROM pred
  UNION ALL SELECT submission_id, test_no + 100, -100, 0.9 FROM pred WHERE test_no = 1)
SELECT round(avg(CASE WHEN (CASE WHEN prob > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 6)
  AS accuracy, count(*) AS valid FROM pad WHERE label <> -100""")
def p8(spark, d):
    """Padded rows carry the -100 sentinel; inside the engine it becomes
    NULL and every metric skips it."""
    p = _pred(spark, d)
    pad = p.where(F.col("test_no") == 1).select(
        "submission_id", (F.col("test_no") + 100).alias("test_no"), F.lit(-100).alias("label"),
        F.lit(0.9).alias("prob"), F.lit(None).cast("double").alias("logit"), F.lit(1).alias("pred"))
    u = p.unionByName(pad).withColumn("label", F.when(F.col("label") != -100, F.col("label")))
    c = M.confusion(u)
    valid = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(r6((F.col("tp") + F.col("tn")).cast("double") / valid).alias("accuracy"),
                    valid.alias("valid"))


@register("M9_majority_baseline", f"""WITH {Q.PRED}
SELECT round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred""")
def m9(spark, d):
    p = M.majority_baseline(A.predictions(spark, d))
    return M.accuracy(p).select(r6("accuracy").alias("accuracy"))


def _draw_sql(seed: int) -> str:
    return (f"CAST('0x' || substr(md5('{seed}|=' || CAST(submission_id AS VARCHAR) || '|=' || CAST(test_no AS VARCHAR)), 1, 13) "
            "AS BIGINT)")


@register("M9_random_baseline", f"""WITH {Q.PRED},
z AS (SELECT label, sqrt(-2 * ln(({_draw_sql(14)} + 0.5) / 4503599627370496)) * cos(2 * pi() * ({_draw_sql(15)} / 4503599627370496)) AS z
  FROM pred)
SELECT round(avg(CASE WHEN label = CASE WHEN z > 0 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM z""")
def m9r(spark, d):
    p = M.random_baseline(A.predictions(spark, d), seed=7, key=["submission_id", "test_no"])
    return M.accuracy(p).select(r6("accuracy").alias("accuracy"))


@register("M10_split_summary", f"""WITH {_LOG}, l2 AS (SELECT *, CASE WHEN loss > 2.5 THEN 1 ELSE 0 END AS acc_hits,
  1 AS acc_n FROM log)
SELECT split, round(avg(loss), 6) AS loss_batch_mean, count(*) AS batches,
  round(sum(acc_hits) / sum(acc_n), 6) AS acc FROM l2 GROUP BY split""")
def m10(spark, d):
    log = A.metric_log(spark, d).withColumn("acc_hits", F.when(F.col("loss") > 2.5, 1).otherwise(0)) \
        .withColumn("acc_n", F.lit(1))
    s = M.aggregate_log(log, by=["split"])
    return s.select("split", r6("loss_batch_mean").alias("loss_batch_mean"), "batches", r6("acc").alias("acc"))


_ELEM = """el AS (SELECT CAST(o_orderkey % 10 AS BIGINT) AS epoch, o_orderpriority AS split,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label, (l_discount - 0.05) * 40 AS logit,
  CASE WHEN 1/(1+exp(-(l_discount - 0.05) * 40)) > 0.5 THEN 1 ELSE 0 END AS pred
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sc AS (SELECT epoch, split, CAST(logit AS DOUBLE) s, sum(label) pos, sum(1-label) neg FROM el GROUP BY ALL),
ca AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY epoch, split ORDER BY s DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) above FROM sc),
auc AS (SELECT epoch, split, sum(neg*(above+pos/2.0))/(sum(pos)*CAST(sum(neg) AS DOUBLE)) AS auc FROM ca GROUP BY ALL),
ea AS (SELECT epoch, split, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS acc_elements,
  sum(pred) AS pred FROM el GROUP BY ALL)"""


@register("A6_element_log", f"""WITH {_LOG}, {_ELEM},
lb AS (SELECT epoch, split, avg(loss) AS loss_batch_mean, count(*) AS batches FROM log GROUP BY ALL)
SELECT lb.epoch, lb.split, round(loss_batch_mean, 6) AS loss_batch_mean, batches,
  round(acc_elements, 6) AS acc_elements, CAST(pred AS BIGINT) AS pred, round(auc, 6) AS auc
FROM lb LEFT JOIN ea USING (epoch, split) LEFT JOIN auc USING (epoch, split)""")
def a6e(spark, d):
    o = A.load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).cast("long").alias("epoch"),
                                          F.col("o_orderpriority").alias("split"))
    li = A.load(spark, d, "lineitem")
    el = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "epoch", "split", F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"),
        ((F.col("l_discount") - 0.05) * 40).alias("logit"))
    el = el.withColumn("pred", M.predict_label("logit"))
    r = M.aggregate_log(A.metric_log(spark, d), elements=el)
    return r.select("epoch", "split", r6("loss_batch_mean").alias("loss_batch_mean"), "batches",
                    r6("acc_elements").alias("acc_elements"), F.col("pred").cast("long").alias("pred"),
                    r6("auc").alias("auc"))
