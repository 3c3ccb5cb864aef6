"""Columns that an operator only passes through, out of reach of its own names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "_others"


def guarded(docs: DataFrame, used: Sequence[str], function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``function`` over the ``used`` columns and one struct of all others, which is unpacked again.

    Whatever the others are called, helper columns of the function neither replace nor meet them. The
    result has the columns of ``docs`` in their order.
    """
    others = [c for c in docs.columns if c not in used]
    packed = [F.struct(*[F.col(f"`{c}`") for c in others]).alias(PACKED)] if others else []
    done = function(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in used], *packed))
    return done.select(
        *[F.col(f"`{c}`") if c in used else F.col(PACKED).getField(c).alias(c) for c in docs.columns]
    )
