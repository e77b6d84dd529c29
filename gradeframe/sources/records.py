"""CSV as pandas reads it, in parallel.

Spark's line-wise CSV reader breaks a record at a line break in quotes; its
multi-line form reads a file in one task and loses the text of some bad rows.
Here a file is read as lines, in splits, and lines are joined to records:

1. Every split tells whether it ends inside quotes if it begins outside, and
   if it begins inside.  From these two bits for each split (a row each) the
   driver follows a file from split to split.
2. The splits are read again; each joins its own lines and gives whole
   records, and a piece at either end where a record goes over a border.  Only
   pieces are shuffled, two a split at most.
3. ``from_csv`` parses the text of a record, which stays beside its fields.

A quote opens where a field begins and closes at the next quote that is not
doubled; other quotes are text.  Line breaks in quotes are kept, empty lines
skipped, empty fields null whether quoted or not.  A record short of fields
has nulls, one with too many is told apart.  No setting of the session is
changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeframe.session import workers_find_package


def scan(line: str, inside: bool, sep: str = ",") -> tuple[bool, int]:
    """Whether the text after ``line`` is inside quotes, and the separators of
    fields in it."""
    at = n = 0
    while True:
        if not inside and line[at:at + 1] == '"':
            inside, at = True, at + 1
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True, n
            if line[at + 1:at + 2] == '"':
                at += 2
                continue
            inside, at = False, at + 1
        at = line.find(sep, at) + 1
        if not at:
            return False, n
        n += 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str], list[int]]]:
    """The lines of each split in a batch, and which of them hold quotes."""
    files, blocks, lines = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
    quoted = pc.indices_nonzero(pc.match_substring(batch.column("value"), '"')).to_pylist()
    start = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or blocks[i] != blocks[start] or files[i] != files[start]:
            yield (files[start], blocks[start]), lines[start:i], [q - start for q in quoted if start <= q < i]
            start = i


def _ends(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for split, lines, quoted in _runs(batch):
                state = ends.setdefault(split, [False, True])
                for q in quoted:
                    state[:] = [scan(lines[q], s, sep)[0] for s in state]
        yield pa.RecordBatch.from_pydict({"file": [f for f, _ in ends], "block": pa.array([b for _, b in ends], pa.int64()),
                                          "from_out": [s[0] for s in ends.values()], "from_in": [s[1] for s in ends.values()]})
    return run


def _join(begins: dict[tuple[str, int], bool], sep: str):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int32()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=["file", "block", "kind", "first", "record", "seps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, inside, kept, kind, first, seps, out = None, False, [], "whole", False, 0, []

        def record(lines: list[str]) -> None:
            nonlocal kind, first, seps
            out.append((*own, kind, first, "\n".join(lines), seps))
            kind, first, seps = "whole", False, 0

        for batch in batches:
            for split, lines, quoted in _runs(batch):
                if split != own:
                    if kept:
                        kind = "middle" if kind == "tail" else "head"
                        record(kept)
                    if split not in begins:
                        raise ValueError(f"{split[0]} was split otherwise when it was first read")
                    own, inside, kept, first = split, begins[split], [], split[1] == 0
                    kind = "tail" if inside else "whole"
                at = 0
                for q in [*quoted, len(lines)]:
                    if inside:
                        kept += lines[at:q]
                    else:
                        for line in lines[at:q]:
                            seps = line.count(sep)
                            record([line])
                    at = q
                    if q == len(lines):
                        break
                    kept.append(lines[q])
                    inside, more = scan(lines[q], inside, sep)
                    seps += more
                    if not inside:
                        record(kept)
                        kept = []
                    at = q + 1
            if out:
                yield table(out)
                out.clear()
        if kept:
            kind = "middle" if kind == "tail" else "head"
            record(kept)
            yield table(out)

    return run


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, first, record, seps): the text of every record and its separators
    of fields; ``first`` marks the first of a file.  One that the file's end leaves open ends there."""
    workers_find_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ends = lines.mapInArrow(_ends(sep), "file string, block long, from_out boolean, from_in boolean")
    begins, file, inside = {}, None, False
    for r in ends.orderBy("file", "block").collect():            # a row for each split
        inside = inside if r.file == file else False
        file, begins[r.file, r.block] = r.file, inside
        inside = r.from_in if inside else r.from_out
    pieces = lines.mapInArrow(_join(begins, sep), "file string, block long, kind string, first boolean, record string, seps int")
    if not any(begins.values()):         # a head is open at the end of its file
        return pieces.select("file", "first", "record", "seps")
    whole = pieces.where("kind = 'whole'").select("file", "first", "record", "seps")
    order = F.struct("block", (F.col("kind") == "head").alias("at"))
    number = F.count_if(F.col("kind") == "head").over(Window.partitionBy("file").orderBy(order))
    joined = pieces.where("kind <> 'whole'").withColumn("n", number).groupBy("file", "n").agg(
        F.bool_or("first").alias("first"),
        F.array_join(F.sort_array(F.collect_list(F.struct(order.alias("o"), "record")))["record"], "\n").alias("record"),
        F.sum("seps").cast("int").alias("seps"))
    return whole.union(joined.select("file", "first", "record", "seps"))


def parse_records(records: DataFrame, columns: list[str], sep: str = ",") -> DataFrame:
    """``columns`` as text, ``line`` (the record) and ``too_long``."""
    got = F.from_csv(F.col("line"), F.lit(", ".join(f"`{c}` string" for c in columns)),
                     {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    lines = records.select(F.regexp_replace("record", "\r$", "").alias("line"), (F.col("seps") >= len(columns)).alias("too_long"))
    parsed = lines.where("line <> ''").select("line", "too_long", got.alias("_f"))
    return parsed.select(*[F.nullif(F.col(f"_f.`{c}`"), F.lit("")).alias(c) for c in columns], "line", "too_long")


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True, sep: str = ",") -> DataFrame:
    """``columns`` as text, ``line`` and ``too_long`` of every record below
    the headers."""
    records = read_records(spark, path, sep)
    return parse_records(records.where(~F.col("first")) if header else records, columns, sep)
