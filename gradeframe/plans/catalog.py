"""Registered queries: one per operator ID of the survey, each with the
equivalent DuckDB SQL used as the correctness oracle.

A query is ``fn(spark, sf_dir) -> DataFrame`` built from gradeframe
operators over the adapters in :mod:`gradeframe.plans.adapters`.  Doubles
are rounded to 6 digits on both sides; column names match exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


# import the query modules for their registration side effects
from gradeframe.plans import q_code, q_curate, q_grade, q_io, q_metrics, q_score, q_text, q_tree  # noqa: E402,F401
