"""Vector scoring.

Vectors are ``array<float|double>`` columns.  Group means use the ML
``Summarizer`` (a JVM aggregate with map-side partial sums over the whole
vector), so a group's rows are never exploded to one row per dimension and
a hot group is pre-combined before the shuffle.  A bank of linear heads is
one packed matrix per problem (test cases x width); rows meet it in Arrow
batches, and a batch's rows of one problem take one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.session import cut_lineage, workers_find_package

BANK_BYTES = 64 << 20      # largest bank that is broadcast
SALT_ROWS = 100_000        # rows of a problem that meet its matrix in one task, else


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Dot product of two equally long arrays."""
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)


def concat_vectors(a, b) -> Column:
    """Prompt embedding followed by code embedding."""
    return F.concat(_c(a), _c(b))


def mean_vector(df: DataFrame, by: list[str], vec: str, out: str = "mean") -> DataFrame:
    """V1: element-wise mean of the vectors of each group."""
    v = df.select(*by, array_to_vector(F.col(vec)).alias("_v"))
    g = v.groupBy(*by).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return g.select(*by, vector_to_array("_m").alias(out))


def masked_mean_vector(df: DataFrame, by: list[str], vec: str, mask: str,
                       eps: float = 1e-8, out: str = "pooled") -> DataFrame:
    """V2: ``sum(x * mask) / (sum(mask) + eps)`` per group."""
    m = F.col(mask).cast("double")
    scaled = F.transform(F.col(vec), lambda x: x.cast("double") * m)
    v = df.select(*by, array_to_vector(scaled).alias("_v"), m.alias("_m"))
    g = v.groupBy(*by).agg(Summarizer.sum(F.col("_v")).alias("_s"), F.sum("_m").alias("_n"))
    return g.select(*by, F.transform(vector_to_array("_s"),
                                     lambda x: x / (F.col("_n") + eps)).alias(out))


def head_logits(df: DataFrame, bank: DataFrame, key: list[str], vec: str,
                weights: str = "weights", head: list[str] | None = None,
                out: str = "logit") -> DataFrame:
    """V3: per row and head, ``logit = x . W[problem, :, head]``.

    ``bank`` has one row per (problem key, head...) with the weight vector.
    It is bounded by the problem catalogue; AQE broadcasts it by its
    measured size (and falls back to a shuffle join if it were large).
    """
    head = head or []
    b = bank.select(*key, *head, F.col(weights).alias("_w"))
    j = df.join(b, key)
    return j.withColumn(out, dot(vec, "_w")).drop("_w")


def pack_bank(heads: DataFrame, key: str, test_no: str = "test_no", weights: str = "weights",
              bias: str | None = None) -> DataFrame:
    """V3: (key, tests, matrix, bias): one row per problem with its heads'
    numbers, the weights packed test after test as doubles, and the biases
    (0 without a column for them).  Heads come in the order of ``test_no``; a
    problem has as many as it has tests, which is the mask of a padded bank."""
    b = F.col(bias).cast("double") if bias else F.lit(0.0)
    own = F.sort_array(F.collect_list(F.struct(F.col(test_no).cast("long").alias("t"), F.col(weights).cast("array<double>").alias("w"),
                                               b.alias("b"))))
    packed = heads.groupBy(F.col(key).alias("_key")).agg(own.alias("_h"))          # T_max heads at most
    return packed.select(F.col("_key").alias(key), F.col("_h.t").alias("tests"), F.flatten("_h.w").alias("matrix"),
                         F.col("_h.b").alias("bias"))


def _products(rows: pa.RecordBatch | pa.Table, found, vec: str) -> tuple[pa.Array, pa.Array]:
    """The test numbers and logits of every row; ``found`` gives (index of
    rows, tests, matrix as tests x width, bias) for each problem in the rows.
    Rows of problems without heads get none."""
    n = rows.num_rows
    tests, logits = [[] for _ in range(n)], [[] for _ in range(n)]
    vectors = rows.column(vec)
    for at, number, matrix, bias in found:
        some = vectors.take(pa.array(at))
        if some.null_count:
            valid = np.flatnonzero(~some.is_null().to_numpy(zero_copy_only=False))
            at, some = at[valid], some.drop_null()
        if not len(at):
            continue
        flat = pa.concat_arrays(some.chunks) if isinstance(some, pa.ChunkedArray) else some
        if flat.flatten().null_count or len(flat.flatten()) != len(at) * matrix.shape[1]:
            raise ValueError(f"vectors of {matrix.shape[1]} numbers are needed")
        x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
        for i, own in zip(at, x @ matrix.T + bias, strict=True):
            tests[i], logits[i] = number, own
    return pa.array(tests, pa.list_(pa.int64())), pa.array(logits, pa.list_(pa.float64()))


def _matrix(bank_row) -> tuple[list[int], np.ndarray, np.ndarray]:
    tests = list(bank_row["tests"])
    return tests, np.asarray(bank_row["matrix"], float).reshape(len(tests), -1), np.asarray(bank_row["bias"], float)


def bank_logits(df: DataFrame, bank: DataFrame, key: str, vec: str, tests: str = "tests", logits: str = "logits",
                bank_bytes: int = BANK_BYTES, salt_rows: int = SALT_ROWS) -> DataFrame:
    """V3: ``df`` with two arrays: the test numbers of the row's problem and
    ``x . W[problem, test] + bias``.  Rows of problems without heads (or with
    a null vector) get empty arrays and stay.

    A bank of ``bank_bytes`` at most is broadcast.  A larger one is dealt by
    problem, with a copy of a problem's matrix for every ``salt_rows`` of its
    rows, so that neither a hot problem nor the bank lies in one task.
    """
    workers_find_package(df.sparkSession)
    bank = cut_lineage(bank)
    schema = f"{df.limit(0)._jdf.schema().toDDL()}, `{tests}` array<long>, `{logits}` array<double>"
    names = [*df.columns, tests, logits]
    size = bank.agg(F.sum(F.size("matrix")) * 8).first()[0] or 0
    if size <= bank_bytes:
        ship = df.sparkSession.sparkContext.broadcast({r[key]: _matrix(r) for r in bank.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                problem = batch.column(key).dictionary_encode()
                code = problem.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                found = [(np.flatnonzero(code == i), *ship.value[p]) for i, p in enumerate(problem.dictionary.to_pylist())
                         if p in ship.value]
                yield pa.RecordBatch.from_arrays([*batch.columns, *_products(batch, found, vec)], names=names)

        return df.mapInArrow(run, schema)
    counts = df.groupBy(F.col(key).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    copies = bank.join(counts, F.col(key) == F.col("_p")).select(
        F.col(key).alias("_p"), "tests", "matrix", "bias",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / salt_rows))).alias("_salt"))
    salted = df.join(counts, F.col(key).eqNullSafe(F.col("_p"))).withColumn(
        "_salt", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.floor(F.col("_n") / salt_rows) + 1)).drop("_p", "_n")

    def meet(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["_salt"])
        found = [(np.arange(rows.num_rows), *_matrix(own.to_pylist()[0]))] if own.num_rows else []
        return pa.Table.from_arrays([*rows.columns, *_products(rows, found, vec)], names=names)

    return salted.groupBy(key, "_salt").cogroup(copies.withColumnRenamed("_p", key).groupBy(key, "_salt")).applyInArrow(meet, schema)


def long_logits(df: DataFrame, keep: list[str], tests: str = "tests", logits: str = "logits") -> DataFrame:
    """One row per row and head: ``keep``, test_no, logit."""
    pairs = F.explode(F.arrays_zip(F.col(tests).alias("t"), F.col(logits).alias("z"))).alias("_p")
    return df.select(*keep, pairs).select(*keep, F.col("_p.t").alias("test_no"), F.col("_p.z").alias("logit"))


def single_head(df: DataFrame, vec: str, weights: list[float], bias: float = 0.0,
                out: str = "logit") -> DataFrame:
    """V4: ``df`` with the logit of one linear head: a bank of one problem
    with one test."""
    spark = df.sparkSession
    bank = spark.createDataFrame([(1, [1], [float(x) for x in weights], [float(bias)])],
                                 "_one int, tests array<long>, matrix array<double>, bias array<double>")
    got = bank_logits(df.withColumn("_one", F.lit(1)), bank, "_one", vec, "_t", "_z")
    return got.withColumn(out, F.get("_z", F.lit(0))).drop("_one", "_t", "_z")


def fit_head_bank(df: DataFrame, head: str, vec: str, label: str, reg: float = 0.01,
                  max_iter: int = 50) -> DataFrame:
    """V7 (re-aimed): fit one logistic head per value of ``head`` in a single
    distributed fit.

    Features are the tensor product of a one-hot head indicator with
    ``[x, 1]`` (``Interaction``), so the problem is block-diagonal and the
    (L2, no shared intercept) objective separates into independent heads;
    one L-BFGS job fits them all.  Returns (head, weights, bias).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer

    d = df.select(F.col(head).cast("string").alias("_h"), vec, F.col(label).cast("double").alias("_y"))
    d = d.withColumn("_x", array_to_vector(F.concat(F.col(vec).cast("array<double>"),
                                                    F.array(F.lit(1.0)))))
    # fitting is an action anyway; the width is one small aggregate
    width = d.select(F.max(F.size(vec))).first()[0] + 1
    # Interaction needs per-element ML attributes on the vector column
    meta = {"ml_attr": {"num_attrs": width, "attrs": {"numeric": [
        {"idx": i, "name": f"x{i}"} for i in range(width)]}}}
    d = d.withColumn("_x", F.col("_x").alias("_x", metadata=meta))
    idx = StringIndexer(inputCol="_h", outputCol="_hi", stringOrderType="alphabetAsc").fit(d)
    d = idx.transform(d)
    d = OneHotEncoder(inputCols=["_hi"], outputCols=["_ho"], dropLast=False).fit(d).transform(d)
    d = Interaction(inputCols=["_ho", "_x"], outputCol="_f").transform(d)
    lr = LogisticRegression(featuresCol="_f", labelCol="_y", fitIntercept=False, regParam=reg,
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    model = lr.fit(d.select("_f", "_y"))
    coef = model.coefficients.toArray()
    rows = [(h, [float(v) for v in coef[i * width:(i + 1) * width - 1]],
             float(coef[(i + 1) * width - 1])) for i, h in enumerate(idx.labels)]
    spark = df.sparkSession
    # one row per head: the number of heads is bounded by the catalogue
    return spark.createDataFrame(rows, f"{head} string, weights array<double>, bias double")
