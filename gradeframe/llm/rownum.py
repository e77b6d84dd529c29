"""Global row numbers without a global sort in one task.

Rows are ordered by an md5 key over their identifying columns.  The first
three hex digits make 4,096 ranges of that order; a row's number is the
number of rows in earlier ranges plus its place in its own range.  Only the
counts of the ranges (4,096 rows, whatever the input) are summed in one task
and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_DIGITS = 3


def order_key(*cols) -> F.Column:
    """md5 over the text form of ``cols``; a null is told from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.md5(F.concat_ws("\x1f", *parts))


def number_rows(df: DataFrame, key: str, ties: list[str], out: str = "row_no") -> DataFrame:
    """Add ``out``: 0..n-1 in the order of (``key``, ``ties``).

    Rows equal in all of these take consecutive numbers in any order.  ``df``
    must be stored (checkpointed) or cheap: it is read twice.
    """
    ranged = df.withColumn("_range", F.substring(key, 1, RANGE_DIGITS))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_range").orderBy(key, *ties)
    return (ranged.withColumn("_place", F.row_number().over(own))
            .join(F.broadcast(offsets), "_range")          # 16^RANGE_DIGITS rows at most
            .withColumn(out, F.col("_before") + F.col("_place") - 1)
            .drop("_range", "_place", "_before"))
