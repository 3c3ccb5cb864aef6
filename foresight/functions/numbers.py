"""Rounding and fixed-digit text on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """Rounding in double arithmetic, ties to even. Stays in generated code, unlike decimal ``round``."""
    scale = float(10**digits)
    return F.rint(value.cast("double") * scale) / scale


def fixed(value: Column, digits: int) -> Column:
    """``value`` with exactly ``digits`` decimals and no grouping, ties to even."""
    pattern = F.lit("0." + "0" * digits if digits else "0")
    return F.call_function("format_number", value.cast("double"), pattern)
