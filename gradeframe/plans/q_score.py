"""Registered vector-scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeframe.operators import score as V
from gradeframe.plans import adapters as A
from gradeframe.plans.catalog import r6, register


@register("V1_mean_vector", """SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (
  SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings)
GROUP BY label, pos""")
def v1(spark, d):
    m = V.mean_vector(A.embeddings(spark, d), ["label"], "embedding")
    return m.select("label", F.posexplode("mean").alias("pos", "mean")) \
        .select("label", F.col("pos").cast("long").alias("pos"), r6("mean").alias("mean"))


@register("V2_masked_mean", """WITH e AS (SELECT label, embedding,
  CASE WHEN embedding[1] > 0 THEN 1.0 ELSE 0.0 END AS m FROM embeddings),
n AS (SELECT label, sum(m) AS n FROM e GROUP BY label),
s AS (SELECT label, pos, sum(CAST(x AS DOUBLE) * m) AS s FROM (
  SELECT label, m, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM e) GROUP BY ALL)
SELECT s.label, pos, round(s / (n + 1e-8), 6) AS pooled FROM s JOIN n USING (label)""")
def v2(spark, d):
    e = A.embeddings(spark, d).withColumn("m", (F.element_at("embedding", 1) > 0).cast("double"))
    p = V.masked_mean_vector(e, ["label"], "embedding", "m")
    return p.select("label", F.posexplode("pooled").alias("pos", "pooled")) \
        .select("label", F.col("pos").cast("long").alias("pos"), r6("pooled").alias("pooled"))


@register("V3_head_logits", """WITH w AS (SELECT label, arg_min(embedding, vec_id) AS w FROM embeddings GROUP BY label)
SELECT e.vec_id, e.label, round(list_sum(list_transform(range(1, len(e.embedding) + 1),
  lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(w.w[i] AS DOUBLE))), 6) AS logit
FROM embeddings e JOIN w USING (label)""")
def v3(spark, d):
    e = A.embeddings(spark, d)
    out = V.head_logits(e, A.head_bank(spark, d), ["label"], "embedding")
    return out.select("vec_id", "label", r6("logit").alias("logit"))


@register("V3_head_bank", """WITH heads AS (SELECT label, t, embedding AS w FROM (SELECT label, embedding,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t FROM embeddings) WHERE t <= 1 + (label * 7) % 26)
SELECT e.vec_id, e.label, h.t AS test_no, round(list_sum(list_transform(range(1, len(e.embedding) + 1),
  lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(h.w[i] AS DOUBLE))) + 0.125 * h.t, 6) AS logit
FROM embeddings e JOIN heads h USING (label)""")
def v3_bank(spark, d):
    """V3: up to 26 heads a problem, another number for each: a label's first
    vectors are its heads."""
    e = A.embeddings(spark, d)
    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    heads = e.select("label", "embedding", t.alias("t")).where(F.col("t") <= 1 + (F.col("label") * 7) % 26)
    bank = V.pack_bank(heads.withColumn("bias", 0.125 * F.col("t")), "label", "t", "embedding", "bias")
    got = V.bank_logits(e.select("vec_id", "label", "embedding"), bank, "label", "embedding")
    return V.long_logits(got, ["vec_id", "label"]).withColumn("logit", r6("logit"))


@register("V4_single_head", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 0.5))
  - 0.25, 6) AS logit FROM embeddings""")
def v4(spark, d):
    e = A.embeddings(spark, d)
    width = e.select(F.max(F.size("embedding"))).first()[0]
    return V.single_head(e, "embedding", [0.5] * width, -0.25).select("vec_id", r6("logit").alias("logit"))


@register("X21_concat_vectors", """SELECT a.vec_id, len(list_concat(a.embedding, b.embedding)) AS width,
  round(list_sum(list_transform(list_concat(a.embedding, b.embedding), lambda x: CAST(x AS DOUBLE))), 6) AS total
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def x21(spark, d):
    e = A.embeddings(spark, d)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("code_emb"))
    j = e.join(b, "vec_id")
    c = V.concat_vectors("embedding", "code_emb")
    return j.select("vec_id", F.size(c).cast("long").alias("width"),
                    r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total"))


@register("X22_explode_aligned", """SELECT o_orderkey, pos, l_linenumber, l_linestatus FROM (
  SELECT o_orderkey, unnest(ln) AS l_linenumber, unnest(ls) AS l_linestatus, unnest(range(0, len(ln))) AS pos
  FROM (SELECT l_orderkey AS o_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS ln,
    list(l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS ls FROM lineitem GROUP BY 1))""")
def x22(spark, d):
    li = A.load(spark, d, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"))).alias("s"))
    z = g.select("o_orderkey", F.posexplode(F.arrays_zip(F.col("s.l_linenumber"), F.col("s.l_linestatus")))
                 .alias("pos", "z"))
    return z.select("o_orderkey", F.col("pos").cast("long").alias("pos"),
                    F.col("z.l_linenumber").alias("l_linenumber"), F.col("z.l_linestatus").alias("l_linestatus"))


@register("V7_fit_head_bank")
def v7(spark, d):
    e = A.embeddings(spark, d).withColumn("y", (F.element_at("embedding", 2) > 0).cast("int"))
    bank = V.fit_head_bank(e, "label", "embedding", "y")
    return bank.select("label", F.size("weights").alias("width"), "bias")
