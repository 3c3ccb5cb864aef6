"""Boolean flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(column: Column | str, null_flag: bool = False) -> Column:
    """A two-valued boolean; a missing flag counts as ``null_flag``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("boolean"), F.lit(null_flag))


def ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """``numerator / denominator`` as a double, ``default`` for a zero or missing denominator."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(value, F.lit(default))
