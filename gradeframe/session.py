"""Session construction and cluster-safe storage helpers."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every gradeframe job wants.  AQE re-plans joins with runtime sizes
# (broadcast only when the measured side is small, otherwise sort-merge) and
# splits skewed shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "gradeframe", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster pass ``master=None`` and let spark-submit decide; the local
    test suite passes ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object store) folder there; we never pick
    a machine-local folder on our own unless the setting is absent, which
    only happens in local runs and tests: elsewhere a missing setting is an
    error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):  # several machines
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="gradeframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the
    driver did; on a cluster it is installed or shipped with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable, survives
    executor loss) and return a DataFrame whose lineage starts there.

    The rows are persisted while the checkpoint is written, so the plan runs
    once (a reliable checkpoint otherwise recomputes it for the write); the
    cache is released as soon as the files exist.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    owned = not df.is_cached          # never drop a cache the caller made
    if owned:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        if owned:
            df.unpersist(blocking=False)


def table_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables", name)


def cut_to_table(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` with less on disk: ``df`` as a parquet table in the
    shared checkpoint folder, written once, compressed, with no cache beside it."""
    path = table_path(df.sparkSession, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the relations ``df`` reads: the sum of the optimizer's size
    estimates of the plan's leaves (planning only, no job).  Unlike the
    estimate of the whole plan it is not inflated by join estimates."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001 - estimate unavailable
        return None


def ensure_parallelism(df: DataFrame, key: list[str] | None = None, factor: int = 2,
                       small_bytes: int = 512 << 20) -> DataFrame:
    """Spread a *small* input over ``factor x defaultParallelism`` partitions
    before heavy per-row work (tokenising, n-gram explosion).

    A small table is often a single split, and a broadcast join keeps that
    single partition, so all per-row work would run in one task.  The
    decision uses the size of the scanned relations (no job runs); inputs
    above ``small_bytes`` already arrive in many splits and are left alone,
    so large inputs get no extra shuffle.  Rows are hashed on
    ``key`` when given (deterministic on retry).
    """
    size = input_bytes(df)
    if size is None or size > small_bytes:
        return df
    target = df.sparkSession.sparkContext.defaultParallelism * factor
    return df.repartition(target, *key) if key else df.repartition(target)


def partition_by_key(df: DataFrame, key: list[str], amount: Column | None = None,
                     per_partition: int = 1) -> DataFrame:
    """Hash-partition ``df`` on ``key`` into
    ``max(spark.sql.shuffle.partitions, 2 x defaultParallelism)`` partitions.

    Used before per-key work whose intermediate rows are much larger than
    the input (n-gram explosion): every later aggregation keyed by a
    superset of ``key`` is then satisfied without another shuffle, so only
    the compact input crosses the network.  The explicit count keeps AQE
    from coalescing the partitions away before the heavy per-row work.

    With ``amount`` (a number for each row) partitions grow with the input
    instead of their number staying: there are as many more as it takes for
    ``per_partition`` of the amount's sum each.  The sum is a job of its own.
    """
    return df.repartition(partitions_for(df, amount, per_partition), *key)


def partitions_for(df: DataFrame, amount: Column | None = None, per_partition: int = 1) -> int:
    """The number of partitions of :func:`partition_by_key`."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
            spark.sparkContext.defaultParallelism * 2)
    if amount is None:
        return n
    total = df.agg(F.sum(amount.cast("double"))).first()[0] or 0.0
    return max(n, math.ceil(total / per_partition))
