"""Sources and sinks.

All reads use explicit schemas (no inference pass over the data) and
columnar parquet for intermediate tables.  CSV is read by
:mod:`gradeframe.sources.records`: a record with *too many* fields is bad, a
short one is kept with NULLs (D1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.operators.ordered import sequence_number
from gradeframe.sources.records import read_csv

# Columns of the raw event log (all read as text first).
EVENT_COLUMNS = [
    "SubjectID", "AssignmentID", "ProblemID", "CodeStateID", "ServerTimestamp", "EventType",
    "Score", "Order", "ToolInstances", "ServerTimezone", "CourseID", "CourseSectionID",
    "Compile.Result", "CompileMessageType", "CompileMessageData", "EventID", "ParentEventID",
    "SourceLocation", "IsEventOrderingConsistent",
]
EVENT_TYPES = {"AssignmentID": T.LongType(), "ProblemID": T.LongType(),
               "ServerTimestamp": T.TimestampType()}
CASE_COLUMNS = ["coding_prompt_id", "input", "expected_output"]

def read_events(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Event log CSV with fixed columns.  A row with too many
    fields ends the read and is named; a short one has nulls, as in pandas."""
    df = read_csv(spark, path, EVENT_COLUMNS, header)
    said = F.concat(F.lit(f"more than {len(EVENT_COLUMNS)} fields: "), "line")
    strict = F.when(F.col("too_long"), F.raise_error(said).cast("string"))
    typed = [F.coalesce(strict, F.col(f"`{c}`")).cast(EVENT_TYPES.get(c, T.StringType())).alias(c) for c in EVENT_COLUMNS]
    return df.select(*typed)


def read_csv_tolerant(spark: SparkSession, path: str, columns: list[str],
                      on_bad: str = "skip", header: bool = True) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Read CSV, dropping records with too many fields (pandas
    ``on_bad_lines='skip'``) or returning them, each with its text in
    ``line``, as a reject table (``'warn'`` -> (good, bad))."""
    df = read_csv(spark, path, columns, header)
    good = df.where(~F.col("too_long")).select(*columns)
    if on_bad == "skip":
        return good
    return good, df.where("too_long").select("line", *columns)


def read_cases(spark: SparkSession, path: str, on_bad: str = "skip", header: bool = True):
    """S2 + P11: the test case table with NaN/NULL ids removed and ids cast
    to long."""
    out = read_csv_tolerant(spark, path, CASE_COLUMNS, on_bad, header)
    good = out if on_bad == "skip" else out[0]
    pid = F.col("coding_prompt_id").try_cast("double")
    good = good.where(pid.isNotNull() & ~F.isnan(pid)).withColumn("coding_prompt_id", pid.cast("long"))
    return good if on_bad == "skip" else (good, out[1])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Single table snapshot (parquet)."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a table snapshot as parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


#: Types in the order in which a column widens when shards differ.
WIDER = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]


def _wider(a: str, b: str, column: str) -> str:
    """The type both shards' values of ``column`` can be read as."""
    if a == b:
        return a
    if a in WIDER[1:] and b in WIDER[1:]:
        a, b = sorted((a, b), key=WIDER.index)
        return "double" if b == "float" and a in ("int", "bigint") else b
    raise ValueError(f"shards hold {column} as {a} and as {b}")


def read_shards(spark: SparkSession, paths: list[str] | str, shard: str | None = None) -> DataFrame:
    """Union of shards in one scan.  A glob is read with one schema; a
    list of paths may hold shards that differ: columns are matched by name
    (those that a shard lacks are null there), numbers take the widest type,
    anything else raises.  ``shard`` names a column for the file's shard: the
    last part of the path it was given by.  Each shard's footer is asked for
    its schema, one after another (shards are few, their files may be many)."""
    if isinstance(paths, str):
        return spark.read.parquet(paths)
    kinds: dict[str, str] = {}
    for path in paths:
        for f in spark.read.parquet(path).schema.fields:
            kind = f.dataType.simpleString()
            kinds[f.name] = _wider(kinds.get(f.name, kind), kind, f.name)
    found = spark.read.schema(", ".join(f"`{c}` {kind}" for c, kind in kinds.items())).parquet(*paths)
    if shard is None:
        return found
    if shard in kinds:
        raise ValueError(f"the shards have a column {shard} of their own")
    names = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    parts = F.split(F.regexp_replace("_metadata.file_path", "%20", " "), "/")
    return found.withColumn(shard, F.filter(parts, lambda x: x.isin(names))[0])


def flatten_nested(df: DataFrame, key: str, value: str, fields: list[str],
                   first: str | None = None) -> DataFrame:
    """A map<key, struct<array fields...>> column (or a struct column
    next to ``key``) -> one row per position; arrays of unequal length are
    cut to the shortest (Python ``zip``, D2).  ``first`` names a column with
    the position of a row's first item (:func:`nest_by_key`); else it is 0."""
    if isinstance(df.schema[value].dataType, T.MapType):
        df = df.select(F.explode(value).alias(key, "_v"))
        value = "_v"
    n = F.array_min(F.array(*[F.size(F.col(f"{value}.{f}")) for f in fields]))
    z = F.arrays_zip(*[F.col(f"{value}.{f}").alias(f) for f in fields])
    start = F.col(first) if first else F.lit(0)
    out = df.select(key, start.alias("_first"), F.posexplode(z).alias("_at", "_z"), n.alias("_n"))
    return out.where(F.col("_at") < F.col("_n")).select(
        key, (F.col("_first") + F.col("_at")).cast("int").alias("pos"), *[F.col(f"_z.{f}").alias(f) for f in fields])


def nest_by_key(df: DataFrame, key: str, order: list[str], fields: list[str],
                max_items: int = 10_000) -> DataFrame:
    """Flat rows -> per-key ordered arrays (the per-student export).

    A key with more than ``max_items`` rows becomes several rows (``chunk``
    0, 1, ...; ``first_pos`` is the 0-based position of its first item), so
    no single collected group is unbounded; every row is kept.  Positions come from the skew-safe :func:`sequence_number`.
    """
    d = sequence_number(df, [key], order, "_pos")
    d = d.withColumn("chunk", F.floor((F.col("_pos") - 1) / max_items).cast("long"))
    g = d.groupBy(key, "chunk").agg(F.sort_array(F.collect_list(
        F.struct(F.col("_pos"), *[F.col(f) for f in fields]))).alias("_s"))
    return g.select(key, "chunk", (F.col("chunk") * max_items).alias("first_pos"), *[F.col(f"_s.{f}").alias(f) for f in fields])


def with_chunk_id(df: DataFrame, order: list[str], rows: int = 2000) -> DataFrame:
    """S7 when a chunk id is needed: consecutive blocks of ``rows`` rows.
    Columns beside ``order`` are best selected away before: all are numbered."""
    d = sequence_number(df, [], order, "_rn")
    return d.withColumn("chunk", F.floor((F.col("_rn") - 1) / rows).cast("long")).drop("_rn")


def write_chunks(df: DataFrame, path: str, rows: int = 2000, order: list[str] | None = None,
                 mode: str = "overwrite") -> DataFrame:
    """Export in chunks of ``rows`` rows of the order of ``order`` (all
    columns, if none), each one file in a folder ``chunk=<id>``; the last chunk
    has what is left.  Returns the manifest (chunk, file, rows), read back
    from the files.  Rows of a chunk meet in one task, chunks are spread."""
    numbered = with_chunk_id(df, order or df.columns, rows)
    dealt = numbered.repartition("chunk").sortWithinPartitions("chunk", *(order or df.columns))
    dealt.write.mode(mode).partitionBy("chunk").parquet(path)
    return chunk_manifest(df.sparkSession, path)


def chunk_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, file, rows) of a folder written by :func:`write_chunks`."""
    files = spark.read.parquet(path).select(F.col("chunk").cast("long").alias("chunk"), F.col("_metadata.file_name").alias("file"))
    return files.groupBy("chunk", "file").agg(F.count(F.lit(1)).alias("rows"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines."""
    df.write.mode(mode).json(path)
