"""Session helpers: planning-only decisions and reliable lineage cuts."""

from pyspark.sql import functions as F

from gradeframe.session import cut_lineage, ensure_parallelism, input_bytes, partition_by_key


def _jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup())


def test_parallelism_guard_runs_no_job(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = _jobs(spark)
    size = input_bytes(df)
    out = ensure_parallelism(df, ["k"])
    assert _jobs(spark) == before
    assert size is not None and size > 0
    assert out.count() == 7


def test_partition_by_key_count(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 5)
    n = partition_by_key(df, ["k"]).rdd.getNumPartitions()
    assert n >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cut_lineage_is_reliable_and_keeps_caller_cache(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    out = cut_lineage(df)
    assert out.count() == 50 and not df.is_cached
    df2 = spark.range(10).cache()
    cut_lineage(df2)
    assert df2.is_cached
    df2.unpersist()
