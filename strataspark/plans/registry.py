"""Named queries with their SQL equivalents.

Both sides round doubles to 6 decimals; integer columns are LONG on both sides."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .bindings import PRELUDE, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, whole: str | None = None):
    """Registers ``fn(inputs) -> DataFrame`` under ``name`` with the SQL body of its oracle, or with its ``whole`` SQL."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(Inputs(spark, sf_dir)))
        if sql or whole:
            ORACLES[name] = whole or PRELUDE + sql
        return fn
    return wrap
