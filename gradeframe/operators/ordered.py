"""Skew-safe ordered computations: prefix sums and sequence numbers.

A plain ``Window.partitionBy(g).orderBy(o)`` sends every row of a group to
one task, and a window without ``partitionBy`` sends the whole table to one
task.  Both break when a group (a student, a split, the whole score domain)
holds a large share of the rows.  Ordered work on such groups goes:

1. Rows are range-partitioned on the whole order: group columns, then order
   columns, of any type.  A large group is spread over as many ranges as its
   share of the rows asks for; small ones share a range.
2. The rows, with the number of their range, are written to the shared
   checkpoint folder, since the sampled range bounds may differ from one
   execution to the next.  The input is read for the sample and once more.
3. Each (group, range) is numbered or summed in its own task, and the totals
   of the group's earlier ranges are added.  Only groups that go over a range
   bound have such totals: fewer rows than there are ranges.

The number of ranges is ``spark.sql.shuffle.partitions`` unless ``ranges``
names another.  The result is exact; the bounds only affect balance.  Rows
that tie in the whole order share a range.  Null keys form one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.session import cut_lineage

_RANGE = "_range"

HOT_ROWS = 1_000_000       # rows of a group that one task sorts


def with_ranges(df: DataFrame, by: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``, the number of the row's range of (``by``,
    ``order``); stored in the shared checkpoint folder."""
    keys = [*[F.col(c) for c in by], *order]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return cut_lineage(dealt.withColumn(_RANGE, F.spark_partition_id()))


def _add_earlier(ranged: DataFrame, by: list[str], total: Column, out: str) -> DataFrame:
    """Add ``out``: ``total`` over the earlier ranges of the row's group (null
    in the first)."""
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, _RANGE).agg(total.alias("_t"))
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(_RANGE).alias("_r"),
                       F.sum("_t").over(earlier).alias(out)).where(F.col(out).isNotNull())
    same = ranged[_RANGE] == sums["_r"]
    for c in by:
        same = same & ranged[c].eqNullSafe(sums[f"_by_{c}"])
    return ranged.join(F.broadcast(sums), same, "left").drop("_r", *[f"_by_{c}" for c in by])


def ordered_prefix_sum(df: DataFrame, order_col: str, value_col: str, out_col: str,
                       by: list[str] | None = None, descending: bool = False,
                       inclusive: bool = True, ranges: int | None = None) -> DataFrame:
    """Running total of ``value_col`` over rows ordered by ``order_col``
    (within ``by``).  RANGE semantics: rows with an equal order value share
    the result; ``inclusive=False`` excludes them (strictly before)."""
    by = list(by or [])
    vt = df.schema[value_col].dataType
    # keep decimal sums exact: one fixed result type for every partial sum
    st = T.DecimalType(min(38, vt.precision + 10), vt.scale) \
        if isinstance(vt, T.DecimalType) else None
    if st is not None:
        df = df.withColumn(value_col, F.col(value_col).cast(st))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    d = _add_earlier(with_ranges(df, by, [order], ranges), by, F.sum(value_col), "_before")
    w_in = Window.partitionBy(*by, _RANGE).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum(value_col).over(w_in)
    if not inclusive:
        run = run - F.sum(value_col).over(Window.partitionBy(*by, _RANGE, order_col))
    before = F.coalesce("_before", F.lit(0))
    res = (before.cast(st) + run.cast(st)).cast(st) if st is not None else before + run
    return d.withColumn(out_col, res).drop("_before", _RANGE)


def sequence_number(df: DataFrame, by: list[str], order_cols: list[str], out_col: str,
                    ranges: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``row_number()`` (1-based) within ``by`` ordered by ``order_cols``.

    Groups of ``hot_rows`` rows at most are numbered by one window, each in a
    task: the rows are shuffled once and nothing is stored.  Larger ones, found
    by an aggregate that reads the group columns alone, and the table as a
    whole where ``by`` is empty, are spread over ranges of the whole order.
    Both give the same numbers; only rows that tie in the whole order may take
    theirs in any order.
    """
    order = [F.col(c) for c in order_cols]

    def window(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out_col, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))

    def spread(rows: DataFrame) -> DataFrame:
        d = _add_earlier(with_ranges(rows, by, order, ranges), by, F.count(F.lit(1)), "_before")
        here = F.row_number().over(Window.partitionBy(*by, _RANGE).orderBy(*order))
        return d.withColumn(out_col, (here + F.coalesce("_before", F.lit(0))).cast("long")).drop("_before", _RANGE)

    if not by:
        return spread(df)
    keys = [F.col(c).alias(f"_hot_{c}") for c in by]
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).drop("_n")
    hot = cut_lineage(hot)                   # a row for every hot_rows rows of df at most
    if hot.isEmpty():
        return window(df)
    same = F.lit(True)
    for c in by:
        same = same & df[c].eqNullSafe(hot[f"_hot_{c}"])
    return window(df.join(hot, same, "left_anti")).unionByName(spread(df.join(hot, same, "left_semi")))
