"""Month-end calendar and elapsed-time expressions on zone-free timestamps."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight import contract


def month_end_frame(
    spark: SparkSession,
    start: str = contract.SNAPSHOT_START,
    end: str = contract.SNAPSHOT_END,
) -> DataFrame:
    """One row per calendar month end in ``[start, end]``, at midnight."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = F.sequence(F.trunc(first, "MM"), last, F.expr("INTERVAL 1 MONTH"))
    return (
        spark.range(1)
        .select(F.explode(months).alias("month"))
        .select(F.last_day("month").alias("day"))
        .filter(F.col("day").between(first, last))
        .select(F.col("day").cast("timestamp_ntz").alias("cutoff_date"))
    )


def month_ends(
    start: str = contract.SNAPSHOT_START, end: str = contract.SNAPSHOT_END
) -> list[datetime]:
    """The same calendar as plain values, for use as literals in a plan."""
    low, high = date.fromisoformat(start), date.fromisoformat(end)
    out, month = [], low.replace(day=1)
    while month <= high:
        following = (month + timedelta(days=32)).replace(day=1)
        last = following - timedelta(days=1)
        if low <= last <= high:
            out.append(datetime(last.year, last.month, last.day))
        month = following
    return out


def ntz(value: datetime | str) -> Column:
    """A zone-free timestamp literal."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def cutoff_array(cutoffs: Sequence[datetime | str]) -> Column:
    """The calendar as one array literal: exploding it needs neither a join nor a broadcast."""
    return F.array(*[ntz(c) for c in cutoffs]).cast("array<timestamp_ntz>")


def _month_number(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def cutoffs_near(cutoffs: Sequence[datetime | str], low: Column, high: Column) -> Column:
    """The part of the calendar from the month of ``low`` to the month of ``high``, as an array.

    A superset of the cutoffs in ``[low, high]`` that is found by position, so that a row fans out to
    the few cutoffs around it and not to the whole calendar. A null ``high`` is open; a null ``low``
    gives no cutoff.
    """
    ordered = sorted(datetime.fromisoformat(c) if isinstance(c, str) else c for c in cutoffs)
    if not ordered:
        return cutoff_array([])
    months = [c.year * 12 + c.month for c in ordered]
    base, span = months[0], months[-1] - months[0] + 1
    before = F.array(*[F.lit(sum(m < base + k for m in months)) for k in range(span + 1)])

    def first_from(month: Column) -> Column:
        return F.get(before, F.greatest(F.lit(0), F.least(F.lit(span), month - base)))

    start = first_from(_month_number(low))
    end = F.coalesce(first_from(_month_number(high) + 1), F.lit(len(ordered)))
    return F.slice(cutoff_array(ordered), start + 1, F.greatest(F.lit(0), end - start))


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} DAYS")


def whole_days(since: Column, until: Column) -> Column:
    """Full 24-hour days from ``since`` to ``until``, never below zero."""
    return F.greatest(F.lit(0), F.extract(F.lit("DAY"), until - since).cast("int"))
