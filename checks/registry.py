"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Dates as ISO text and decimals as doubles: types that compare alike across engines."""
    dates = {f.name: F.col(f.name).cast("string") for f in df.schema if f.dataType == T.DateType()}
    decimals = {
        f.name: F.col(f.name).cast("double")
        for f in df.schema
        if isinstance(f.dataType, T.DecimalType)
    }
    changes = {**dates, **decimals}
    return df.withColumns(changes) if changes else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` the driver only checks that rows come back."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(function(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register
