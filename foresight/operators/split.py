"""Chronological train / holdout split."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresight import contract
from foresight.operators.ranking import with_row_number


def _train_size(n: int, test_ratio: float) -> int:
    return int(n * (1.0 - test_ratio))


def split_by_position(
    df: DataFrame,
    order_cols: Sequence[str],
    test_ratio: float = contract.TEST_RATIO,
    at_least: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """The first rows in ``order_cols`` order to train, the rest to holdout.

    ``order_cols`` has to be unique per row. Only these columns are sorted; the key of the last train
    row then cuts the frame by two filters.
    """
    if not order_cols:
        raise ValueError("a split by position needs order_cols: Spark rows have no order")
    n = df.count()
    size = max(at_least, _train_size(n, test_ratio))
    if size >= n:
        return df, df.limit(0)
    if size == 0:
        return df.limit(0), df
    ranked = with_row_number(df.select(*order_cols), order_cols, "_position")
    last = ranked.filter(F.col("_position") == size).drop("_position").first()
    edge = F.struct(*[F.lit(last[c]).cast(df.schema[c].dataType).alias(c) for c in order_cols])
    key = F.struct(*order_cols)
    return df.filter(key <= edge), df.filter(key > edge)


def temporal_split(
    df: DataFrame,
    split_date: date | datetime | str | None = None,
    test_ratio: float = contract.TEST_RATIO,
    cutoff_col: str = "cutoff_date",
    order_cols: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Earlier cutoffs to train, later ones to holdout: two filters over one frame.

    Only the distinct cutoffs (one per snapshot month) reach the driver. Without a cutoff column,
    with a single cutoff, or when one side would be empty, rows are split by ``order_cols`` instead.
    """
    if cutoff_col not in df.columns:
        return split_by_position(df, order_cols, test_ratio, at_least=0)
    known = df.select(cutoff_col).dropna().distinct().orderBy(cutoff_col)
    cutoffs = [r[0] for r in known.collect()]
    if len(cutoffs) < 2:
        return split_by_position(df, order_cols, test_ratio)
    if split_date is None:
        boundary = cutoffs[max(1, _train_size(len(cutoffs), test_ratio))]
    else:
        boundary = split_date
    edge = F.lit(boundary).cast(df.schema[cutoff_col].dataType)
    typed = df.sparkSession.range(1).select(edge).first()[0]  # compared as the column compares it
    if not cutoffs[0] < typed <= cutoffs[-1]:
        return split_by_position(df, order_cols, test_ratio)
    return df.filter(F.col(cutoff_col) < edge), df.filter(F.col(cutoff_col) >= edge)
