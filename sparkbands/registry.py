"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine digits: sums over shuffles differ in the last ones."""
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    """Register a function of the tables under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(Views(spark, sf_dir)))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return put
