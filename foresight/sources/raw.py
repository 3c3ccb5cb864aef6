"""Readers of the four raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from foresight import contract
from foresight.functions.flags import flag


def _opened(spark: SparkSession, directory: str, table: str, fmt: str, suffix: str | None) -> DataFrame:
    path = f"{directory.rstrip('/')}/{table}{'.' + fmt if suffix is None else suffix}"
    try:
        if fmt == "csv":
            found = spark.read.option("header", True).csv(path)
        else:
            found = spark.read.format(fmt).load(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"{table}: no {fmt} data at {path}") from error
    return found


def read_raw(
    spark: SparkSession, directory: str, table: str, fmt: str = "csv", suffix: str | None = None
) -> DataFrame:
    """One raw table with its declared schema; a missing path names the table.

    CSV columns are matched by header name, so files may order or extend their columns freely.
    """
    return conform(_opened(spark, directory, table, fmt, suffix), table)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Declared columns in declared types; text dates and timestamps are parsed by the cast."""
    schema = contract.RAW_TABLES[table]
    optional = _OPTIONAL | (_OPTIONAL_IN_ACCOUNTS if table == "accounts" else set())
    missing = [f.name for f in schema if f.name not in df.columns and f.name not in optional]
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    return df.select(*[_typed(df, f).alias(f.name) for f in schema if f.name in df.columns])


def _typed(df: DataFrame, field: T.StructField) -> Column:
    """A plain cast, but whole numbers may be written as ``30.0``; a fraction names its column."""
    column = F.col(field.name)
    if not (isinstance(field.dataType, T.IntegralType) and df.schema[field.name].dataType == T.StringType()):
        return column.cast(field.dataType)
    number = column.cast("decimal(38, 9)")
    whole = number == F.floor(number)
    complaint = F.concat(F.lit(f"{field.name} is not a whole number: "), column)
    return F.when(number.isNull() | whole, number.cast(field.dataType)).otherwise(
        F.raise_error(complaint).cast(field.dataType)
    )


# Columns that no operator reads, or that are normalised only where they exist.
_OPTIONAL = {
    "account_name",
    "churn_flag",
    "upgrade_flag",
    "downgrade_flag",
    "usage_id",
}
_OPTIONAL_IN_ACCOUNTS = {"plan_tier", "seats", "is_trial"}


def normalise_flags(df: DataFrame, table: str, null_flag: bool = False) -> DataFrame:
    """Two-valued boolean flags where the columns exist; a missing value becomes ``null_flag``."""
    present = [c for c in contract.FLAG_COLUMNS[table] if c in df.columns]
    return df.withColumns({c: flag(c, null_flag) for c in present}) if present else df


def load_raw(
    spark: SparkSession,
    directory: str,
    fmt: str = "csv",
    tables: dict[str, DataFrame] | None = None,
    null_flag: bool = False,
) -> dict[str, DataFrame]:
    """The four tables by name: the caller's frames where given, files otherwise."""
    given = tables or {}
    return {
        name: normalise_flags(
            given[name] if name in given else read_raw(spark, directory, name, fmt), name, null_flag
        )
        for name in contract.RAW_TABLES
    }


def split_bad_rows(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose values all fit the declared types, typed, and the others as they came.

    A bad row keeps its raw columns and names the columns that do not fit in ``bad_columns``. Nulls are
    no fault; neither are columns that the schema does not know. Both come from the same scan's columns,
    without a shuffle.
    """
    schema = contract.RAW_TABLES[table]
    optional = _OPTIONAL | (_OPTIONAL_IN_ACCOUNTS if table == "accounts" else set())
    missing = [f.name for f in schema if f.name not in df.columns and f.name not in optional]
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    present = [f for f in schema if f.name in df.columns]
    typed = {f.name: _tried(df, f) for f in present}
    faults = [F.when(F.col(n).isNotNull() & c.isNull(), F.lit(n)) for n, c in typed.items()]
    marked = df.withColumn("bad_columns", F.array_compact(F.array(*faults)))
    good = marked.filter(F.size("bad_columns") == 0).select(*[c.alias(n) for n, c in typed.items()])
    return good, marked.filter(F.size("bad_columns") > 0)


def _tried(df: DataFrame, field: T.StructField) -> Column:
    """As ``_typed``, but null where a value does not fit."""
    column = F.col(field.name)
    if not (isinstance(field.dataType, T.IntegralType) and df.schema[field.name].dataType == T.StringType()):
        return column.try_cast(field.dataType)
    number = column.try_cast("decimal(38, 9)")
    return F.when(number == F.floor(number), number).try_cast(field.dataType)


def read_quarantined(
    spark: SparkSession, directory: str, table: str, fmt: str = "csv", suffix: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``read_raw`` that sets bad rows aside instead of failing on them."""
    return split_bad_rows(_opened(spark, directory, table, fmt, suffix), table)
