"""Where the catalogue's queries register themselves with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.columns import tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Columns in one form for comparison: doubles rounded to six places, whole numbers long."""
    kinds = dict(df.dtypes)

    def one(c: str):
        if kinds[c] in ("double", "float"):
            return tidy(F.col(c)).alias(c)
        return F.col(c).cast("long").alias(c) if kinds[c] in ("int", "tinyint", "smallint") else F.col(c)

    return df.select(*(one(c) for c in columns or df.columns))


def r6(expression: str) -> str:
    return f"(round(CAST({expression} AS DOUBLE), 6) + 0.0)"
