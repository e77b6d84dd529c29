"""Registered source/sink queries (S4-S8) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.sources import io as S
from gradeframe.plans.catalog import register


@register("S4_read_table", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders""")
def s4(spark, d):
    """The table written as a snapshot and read back."""
    path = _derived_csv_dir(spark, d, "orders_snapshot")
    S.write_table(S.read_table(spark, f"{d}/orders.parquet"), path)
    return S.read_table(spark, path).select("o_orderkey", "o_custkey", "o_totalprice")


@register("S5_read_shards", """SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang""")
def s5(spark, d):
    return S.read_shards(spark, f"{d}/doc*.parquet").groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


def _nested(spark, d):
    """Per customer a struct of parallel arrays over their orders (the
    nested per-student export shape), then flattened back (S6)."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    n = S.nest_by_key(o, "o_custkey", ["o_orderkey"], ["o_orderkey", "o_totalprice"])
    return n.select("o_custkey", "chunk", "first_pos", F.struct(F.col("o_orderkey").alias("keys"),
                                                                F.col("o_totalprice").alias("prices")).alias("v"))


@register("S8_nest_by_key", """SELECT o_custkey, chunk, count(*) AS n_orders,
  string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM (SELECT *, CAST((row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10000 AS BIGINT) AS chunk FROM orders) GROUP BY o_custkey, chunk""")
def s8(spark, d):
    n = _nested(spark, d)
    return n.select("o_custkey", "chunk", F.size("v.keys").cast("long").alias("n_orders"),
                    F.array_join(F.col("v.keys").cast("array<string>"), ",").alias("keys"))


@register("S6_flatten_nested", """SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1
  AS INTEGER) AS pos, o_orderkey AS keys, o_totalprice AS prices FROM orders""")
def s6(spark, d):
    return S.flatten_nested(_nested(spark, d), "o_custkey", "v", ["keys", "prices"], "first_pos")


@register("S7_chunk_ids", """SELECT chunk, count(*) AS rows FROM (SELECT CAST((row_number() OVER (ORDER BY
  l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 2000 AS BIGINT) AS chunk FROM lineitem) GROUP BY 1""")
def s7(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    c = S.with_chunk_id(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 2000)
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))


@register("S7_chunk_files", """SELECT chunk, count(*) AS rows, CAST(1 AS BIGINT) AS files, min(l_orderkey) AS first_key,
  max(l_orderkey) AS last_key FROM (SELECT *, CAST((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey,
  l_suppkey) - 1) // 2000 AS BIGINT) AS chunk FROM lineitem) GROUP BY 1""")
def s7_files(spark, d):
    """Chunk files written, and read back by file."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    path = _derived_csv_dir(spark, d, "lineitem_chunks")
    manifest = S.write_chunks(spark.read.parquet(f"{d}/lineitem.parquet").select(*order), path, 2000, order)
    keys = spark.read.parquet(path).groupBy(F.col("chunk").cast("long").alias("chunk")).agg(
        F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))
    return manifest.groupBy("chunk").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files")).join(keys, "chunk")


@register("S5_shards_with_drift", """SELECT 'shard' || CAST(o_orderkey % 7 AS VARCHAR) AS shard, count(*) AS rows,
  count(*) FILTER (WHERE o_orderkey % 7 <> 3) AS with_status, CAST(sum(o_custkey) AS BIGINT) AS custkeys,
  round(sum(CASE WHEN o_orderkey % 7 = 5 THEN floor(o_totalprice) ELSE o_totalprice END), 2) AS price,
  count(*) FILTER (WHERE o_orderkey % 7 = 6) AS noted FROM orders GROUP BY 1""")
def s5_drift(spark, d):
    """Seven shards; some lack a column, one has another order of columns,
    one whole prices, some narrower keys, one a column of its own."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    paths = []
    for i in range(7):
        part = o.where(F.col("o_orderkey") % 7 == i)
        if i == 2:
            part = part.select("o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey")
        if i == 3:
            part = part.drop("o_orderstatus")
        if i in (1, 4):
            part = part.withColumn("o_custkey", F.col("o_custkey").cast("int"))
        if i == 5:
            part = part.withColumn("o_totalprice", F.floor("o_totalprice").cast("int"))
        if i == 6:
            part = part.withColumn("note", F.lit("late"))
        paths.append(_derived_csv_dir(spark, d, "orders_shards") + f"/shard{i}")
        S.write_table(part, paths[-1])
    return S.read_shards(spark, paths, "shard").groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.count("o_orderstatus").alias("with_status"), F.sum("o_custkey").alias("custkeys"),
        F.round(F.sum("o_totalprice"), 2).alias("price"), F.count("note").alias("noted"))


def _derived_csv_dir(spark, d, name):
    import os
    from gradeframe.session import table_path
    tag = os.path.basename(d.rstrip("/"))
    return table_path(spark, f"{name}_{tag}")


def _cases_csv(spark, d, name):
    """Write a test-case CSV derived from lineitem (no header, many files):
    some ids are 'nan', some lines carry one field too many."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    pid = F.when(F.col("l_quantity") > 49, F.lit("nan")).otherwise(F.col("l_partkey").cast("string"))
    line = F.concat_ws(",", pid, F.col("l_returnflag"), F.col("l_linestatus"),
                       F.when(F.col("l_discount") > 0.09, F.lit("EXTRA")))
    path = _derived_csv_dir(spark, d, name)
    li.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


@register("S2_read_cases_skip", """SELECT CAST(l_partkey AS BIGINT) AS coding_prompt_id, l_returnflag AS input,
  l_linestatus AS expected_output FROM lineitem WHERE NOT l_discount > 0.09 AND NOT l_quantity > 49""")
def s2(spark, d):
    return S.read_cases(spark, _cases_csv(spark, d, "cases_skip_csv"), on_bad="skip", header=False)


@register("S3_read_cases_reject", """SELECT count(*) AS rejected FROM lineitem WHERE l_discount > 0.09""")
def s3(spark, d):
    _, bad = S.read_cases(spark, _cases_csv(spark, d, "cases_reject_csv"), on_bad="warn", header=False)
    return bad.agg(F.count(F.lit(1)).alias("rejected"))


@register("S1_read_events", """SELECT EventType, count(*) AS cnt, count(DISTINCT SubjectID) AS subjects
FROM (SELECT CAST(user_id AS VARCHAR) AS SubjectID, event_type AS EventType FROM events) GROUP BY 1""")
def s1(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    cols = {c: F.lit(None).cast("string") for c in S.EVENT_COLUMNS}
    cols.update({"SubjectID": F.col("user_id").cast("string"), "AssignmentID": F.col("user_id"),
                 "ProblemID": F.col("event_id"), "CodeStateID": F.col("event_id").cast("string"),
                 "ServerTimestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                 "EventType": F.col("event_type"), "Score": F.col("value").cast("string")})
    path = _derived_csv_dir(spark, d, "main_table_csv")
    ev.select(*[cols[c].alias(c) for c in S.EVENT_COLUMNS]).write.mode("overwrite") \
        .option("header", True).csv(path)
    e = S.read_events(spark, path)
    return e.groupBy("EventType").agg(F.count(F.lit(1)).alias("cnt"),
                                      F.count_distinct("SubjectID").alias("subjects"))


@register("S9_write_csv", """SELECT l_returnflag, l_linestatus, count(*) AS cnt FROM lineitem GROUP BY 1, 2""")
def s9(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    summary = li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("cnt"))
    path = _derived_csv_dir(spark, d, "summary_csv")
    S.write_csv(summary, path)
    return spark.read.schema("l_returnflag string, l_linestatus string, cnt bigint") \
        .option("header", True).csv(path)


@register("S10_write_results", """SELECT o_orderpriority, count(*) AS cnt, round(avg(o_totalprice), 6) AS mean_price
FROM orders GROUP BY 1""")
def s10(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    res = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("cnt"),
                                           F.round(F.avg("o_totalprice"), 6).alias("mean_price"))
    path = _derived_csv_dir(spark, d, "results_json")
    S.write_results(res, path)
    return spark.read.schema("o_orderpriority string, cnt bigint, mean_price double").json(path)


def _quoted_cases(spark, d, name):
    """Documents as cases without a header: quotes and line breaks in quotes,
    short rows, and rows with one or two fields too many (empty ones too)."""
    i = F.col("doc_id")
    body = F.concat(F.lit('say "'), F.coalesce("text", F.lit("")), F.lit('"\nend'))
    quoted = F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.when(i % 7 == 0, i.cast("string")).when(i % 5 == 0, F.concat_ws(",", i, quoted, "lang", F.lit("EXTRA"))) \
        .when(i % 11 == 0, F.concat_ws(",", i, F.lit(""), "lang", F.lit(""), F.lit(""))).otherwise(F.concat_ws(",", i, quoted, "lang"))
    path = _derived_csv_dir(spark, d, name)
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("lang", F.coalesce("lang", F.lit("")))
    docs.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


_BODY = """'say "' || coalesce(text, '') || '"' || chr(10) || 'end'"""


@register("S2_quoted_records", f"""SELECT doc_id AS coding_prompt_id,
  CASE WHEN doc_id % 7 <> 0 THEN md5({_BODY}) END AS input_md5,
  CASE WHEN doc_id % 7 <> 0 THEN nullif(lang, '') END AS expected_output
FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 5 <> 0 AND doc_id % 11 <> 0)""")
def s2_quoted(spark, d):
    good = S.read_cases(spark, _quoted_cases(spark, d, "quoted_skip_csv"), header=False)
    return good.select("coding_prompt_id", F.md5("input").alias("input_md5"), "expected_output")


@register("S3_quoted_rejects", f"""SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0
    THEN doc_id || ',"' || replace({_BODY}, '"', '""') || '",' || coalesce(lang, '') || ',EXTRA'
    ELSE doc_id || ',,' || coalesce(lang, '') || ',,' END) AS line_md5
FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR doc_id % 11 = 0)""")
def s3_quoted(spark, d):
    _, bad = S.read_cases(spark, _quoted_cases(spark, d, "quoted_reject_csv"), on_bad="warn", header=False)
    return bad.select(F.col("coding_prompt_id").cast("long").alias("doc_id"), F.md5("line").alias("line_md5"))


@register("S1_short_rows", """SELECT event_type AS EventType, count(*) AS cnt,
  count(*) FILTER (WHERE event_id % 3 <> 0) AS scored, count(*) FILTER (WHERE event_id % 3 = 1) AS messages,
  CAST(sum(CASE WHEN event_id % 3 = 1 THEN length('at "' || event_type || '",' || chr(10) || CAST(event_id AS VARCHAR))
    ELSE 0 END) AS BIGINT) AS message_chars FROM events GROUP BY 1""")
def s1_short(spark, d):
    """Rows that end after the event type or the score, and messages with
    quotes, separators and line breaks."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k, at = F.col("event_id"), S.EVENT_COLUMNS.index("CompileMessageData")
    start = F.concat_ws(",", F.col("user_id").cast("string"), F.lit("1"), k.cast("string"), F.lit("c"),
                        F.lit("2024-01-01 00:00:00"), "event_type")
    message = F.concat(F.lit('"at ""'), "event_type", F.lit('"",\n'), k.cast("string"), F.lit('"'))
    line = F.when(k % 3 == 0, start).when(k % 3 == 2, F.concat(start, F.lit(",0.5"))).otherwise(
        F.concat(start, F.lit(",1" + "," * (at - 6)), message, F.lit("," * (len(S.EVENT_COLUMNS) - 1 - at))))
    path = _derived_csv_dir(spark, d, "short_events_csv")
    e.select(line.alias("value")).write.mode("overwrite").text(path)
    found = S.read_events(spark, path, header=False)
    return found.groupBy("EventType").agg(
        F.count(F.lit(1)).alias("cnt"), F.count("Score").alias("scored"), F.count("CompileMessageData").alias("messages"),
        F.coalesce(F.sum(F.length("CompileMessageData")), F.lit(0)).cast("long").alias("message_chars"))
