"""Per-cutoff figures folded into one map per entity, so joins run at entity grain.

A map has at most one entry per cutoff. Joining it before cutoffs are exploded shuffles one row per
subscription or account instead of one per subscription and cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_by_cutoff(df: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, name: map<cutoff_date, struct of the other columns>)``."""
    figures = F.struct(*[c for c in df.columns if c not in (key, "cutoff_date")])
    entry = F.struct(F.col("cutoff_date"), figures)
    return df.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def at_cutoff(name: str, field: str) -> Column:
    """A figure at the row's cutoff, zero when the entity had no activity in the window."""
    figures = F.try_element_at(F.col(name), F.col("cutoff_date"))
    return F.coalesce(figures.getField(field).cast("double"), F.lit(0.0))
