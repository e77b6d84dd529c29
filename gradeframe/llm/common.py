"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.session import cut_lineage, ensure_checkpoint_dir  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    _workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _workers_find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the
    driver did; on a cluster it is installed or shipped with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    return cut_lineage(df)


def text_blocks(batch: pa.RecordBatch, text: str = "text", max_chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Cut an Arrow batch into runs of rows of about ``max_chars`` of text, so
    that work arrays follow that size and not the number of rows; yields the
    first row's position and the texts (null reads as empty).  Texts are never
    cut: one longer than ``max_chars`` makes a run of its own."""
    column = batch.column(text)
    run: list[str] = []
    start = size = 0
    for i in range(0, len(column), 128):
        for j, t in enumerate(column.slice(i, 128).to_pylist(), i):
            t = t or ""
            if run and size + len(t) > max_chars:
                yield start, run
                run, start, size = [], j, 0
            run.append(t)
            size += len(t)
    if run:
        yield start, run


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives its task's memory back to the system.

    Workers are reused: what the allocators hold of one stage's arrays would
    stay beside those of the next, and an executor's memory would climb from
    stage to stage."""
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):     # another C library
                pass

    return task


def content_key(col: str = "text") -> list:
    """Two differently seeded 64-bit hashes of a column: a 128-bit key of its
    value (null has its own)."""
    c = F.col(col)
    return [F.xxhash64(F.lit(1), c, F.isnull(c)).alias("k1"), F.xxhash64(F.lit(2), c, F.isnull(c)).alias("k2")]


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a checkpointed or stored ``df`` has at most ``rows`` rows: the
    check that every explicit broadcast here stands behind."""
    return df.limit(rows + 1).count() <= rows


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; where the package that holds them is
    absent, the folder named by GRADEFRAME_TOKENIZERS."""
    folder = os.environ.get("GRADEFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder, at a path of its own,
    and read it again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
