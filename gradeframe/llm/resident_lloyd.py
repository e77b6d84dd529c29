"""Product quantisation by Lloyd rounds over members that stay where they are.

Every vector becomes integers ``floor(256 x)`` and is cut into ``POSITIONS``
equal parts.  A part is a row of its owner (position, entry, salt): the entry
of its position's codebook that it was nearest to, and a share of that entry's
rows, so that a hot entry (very many equal vectors) has many owners.

* The first assignment deals all parts to their owners, once.
* In a round every owner sums its resident members; only those sums, and from
  them the codebooks (``POSITIONS x ENTRIES`` rows whatever the input), leave
  it.  Residents are then judged by the new codebooks in place.  Those whose
  entry is the same stay in their partition; only the others pass the next
  shuffle, to the owners of their new entry.
* After the last round the residents are judged once more, and a vector's
  parts are brought together by its row number for its code and error.

Dropped: null vectors and those with null or non-finite components; also
vectors whose length differs from that of the smallest vec_id's (of the
lengths that can be cut, positive multiples of ``POSITIONS``).  Smallest
vec_ids: null ones last, equal ones by their vector.  With fewer vectors than
``ENTRIES`` the codebooks have as many entries.  Repeated rows all count and
all come back.  Components saturate where squared distances would leave a long
(beyond 2^27 for 64 of them); a label's error does at the greatest long.
Columns other than vec_id, embedding and label are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import common

POSITIONS = 16
ENTRIES = 64
ROUNDS = 2
OWNED = 4096               # rows of an entry for each owner, if all rows were its
OWNER = ["position", "entry", "salt"]


def saturation(dim: int) -> int:
    """Largest absolute component whose errors fit into a long."""
    return 1 << min(30, (62 - (dim - 1).bit_length()) // 2 - 1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (ties: the lowest) and its
    squared distance, in exact integers."""
    index, error = np.empty(len(parts), np.int32), np.empty(len(parts), np.int64)
    for at in range(0, len(parts), 4096):
        some = parts[at:at + 4096].astype(np.int64)
        distance = np.zeros((len(some), len(entries)), np.int64)
        for j in range(parts.shape[1]):
            step = some[:, j, None] - entries[None, :, j]
            distance += step * step
        index[at:at + 4096] = best = distance.argmin(1)
        error[at:at + 4096] = distance[np.arange(len(some)), best]
    return index, error


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that can be cut, before lengths are
    compared."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.select("vec_id", "label", vector.alias("vector")).where(
        (F.size("vector") > 0) & (F.size("vector") % POSITIONS == 0) & finite)


def _first_parts(rows: DataFrame, books: np.ndarray, dim: int, salts: int) -> DataFrame:
    """All parts with their first entries."""
    width, most = dim // POSITIONS, saturation(dim)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = integers(batch.column("vector").flatten().to_numpy(zero_copy_only=False), most).reshape(-1, dim)
            for p in range(POSITIONS):
                own = np.ascontiguousarray(vectors[:, p * width:(p + 1) * width])
                entry, _ = nearest(own, books[p])
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, p, np.int32)), pa.array(entry), batch.column("salt"), batch.column("row"),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(own.ravel()))],
                    names=[*OWNER, "row", "part"])

    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt")
    return rows.select("row", "vector", salt).mapInArrow(cut, "position int, entry int, salt int, row long, part array<int>")


def integers(x: np.ndarray, most: int) -> np.ndarray:
    return np.clip(np.floor(256 * x), -most, most).astype(np.int32)


def _judge(residents: DataFrame, books: np.ndarray) -> DataFrame:
    """``residents`` with their nearest entry now and its squared distance."""
    width = books.shape[2]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("position").to_numpy()
            parts = batch.column("part").flatten().to_numpy().reshape(-1, width)
            now, error = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                now[at], error[at] = nearest(parts[at], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(now), pa.array(error)],
                                             names=[*batch.schema.names, "now", "error"])

    return residents.mapInArrow(
        judge, "position int, entry int, salt int, row long, part array<int>, now int, error long")


def _update(residents: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of the residents' means, rounded down; entries without
    members stay."""
    owned = residents.groupBy(*OWNER).agg(F.count(F.lit(1)).alias("n"),
                                          *[F.sum(F.col("part")[j]).alias(f"s{j}") for j in range(books.shape[2])])
    sums = owned.groupBy("position", "entry").agg(F.sum("n").alias("n"),
                                                  *[F.sum(f"s{j}").alias(f"s{j}") for j in range(books.shape[2])])
    new = books.copy()
    for r in sums.collect():                 # POSITIONS x ENTRIES rows at most
        new[r["position"], r["entry"]] = [s // r["n"] for s in r[3:]]
    return new


def compress(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, code as array, error) of every kept row, with the final
    codebooks (their integers by part, entry and position) in ``codebooks``."""
    spark = embeddings.sparkSession
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    kept = kept_vectors(embeddings)
    first = kept.orderBy(*order).limit(1).collect()
    dim = len(first[0]["vector"]) if first else POSITIONS
    rows = common.stored(kept.where(F.size("vector") == dim).withColumn("row", F.monotonically_increasing_id()))
    start = np.array([r["vector"] for r in rows.orderBy(*order).limit(ENTRIES).collect()], float).reshape(-1, dim)
    books = integers(start, saturation(dim)).astype(np.int64).reshape(-1, POSITIONS, dim // POSITIONS).transpose(1, 0, 2)
    salts = max(1, -(-rows.count() // OWNED))
    residents = common.checkpoint(_first_parts(rows, books, dim, salts).repartition(*OWNER))
    for _ in range(ROUNDS - 1):
        books = _update(residents, books)
        judged = common.checkpoint(_judge(residents, books))
        stay = judged.where("now = entry").select(*residents.columns)
        move = judged.where("now <> entry").select("position", F.col("now").alias("entry"), "salt", "row", "part")
        residents = stay.union(move.repartition(*OWNER))
    books = _update(residents, books)
    coded = _judge(residents, books).groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "now"))), lambda x: x["now"]).alias("code"),
        F.sum("error").alias("error"))
    flat = F.lit(",".join(str(x) for x in books.ravel().tolist()))
    return rows.select("row", "vec_id", "label").join(coded, "row").select(
        "vec_id", "label", "code", "error", flat.alias("codebooks"))


def op11_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = common.stored(compress(common.read(spark, sf_dir, "embeddings")))
    greatest = F.lit(2 ** 63 - 1).cast("decimal(38,0)")
    labels = coded.groupBy(F.col("label").alias("_label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), greatest).cast("long").alias("label_error"))
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", digits.alias("code"), "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in DuckDB, for vectors of 64 components."""
    xs = ["x1", "x2", "x3", "x4"]
    nearest_entry = """{a} AS (SELECT t.vec_id, t.p, x1, x2, x3, x4, min(
        ((x1-c1)*(x1-c1) + (x2-c2)*(x2-c2) + (x3-c3)*(x3-c3) + (x4-c4)*(x4-c4)) * 64 + e) AS m
      FROM parts t JOIN {c} c ON t.p = c.p GROUP BY ALL)"""
    down = "(s{j} - ((s{j} % n) + n) % n) // n"
    update = """{c} AS (SELECT b.p, b.e, {means} FROM {old} b LEFT JOIN (
        SELECT p, (m % 64) AS e, count(*) AS n, {sums} FROM {a} GROUP BY ALL) u ON b.p = u.p AND b.e = u.e)"""
    sums = ", ".join(f"CAST(sum({x}) AS BIGINT) AS s{j}" for j, x in enumerate(xs, 1))
    means = ", ".join(f"CASE WHEN n IS NULL THEN b.c{j} ELSE {down.format(j=j)} END AS c{j}" for j in range(1, 5))
    steps = []
    for k in range(ROUNDS):
        steps.append(nearest_entry.format(a=f"a{k}", c=f"b{k}"))
        steps.append(update.format(c=f"b{k + 1}", old=f"b{k}", a=f"a{k}", sums=sums, means=means))
    steps.append(nearest_entry.format(a="last", c=f"b{ROUNDS}"))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[4*p+1] AS x1, v[4*p+2] AS x2, v[4*p+3] AS x3, v[4*p+4] AS x4
    FROM kept, range(16) r(p)),
b0 AS (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x1 AS c1, x2 AS c2, x3 AS c3, x4 AS c4
    FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(c1 || ',' || c2 || ',' || c3 || ',' || c4, ',' ORDER BY p, e)) AS codebooks_sha256
    FROM b{ROUNDS}),
coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m % 64)), 2, '0'), '' ORDER BY p) AS code,
    CAST(sum(m // 64) AS BIGINT) AS error FROM last GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books"""


ORACLE_SQL = _oracle()
