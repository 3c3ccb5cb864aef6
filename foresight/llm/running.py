"""Running totals along a total order, without one task that holds all rows or one large key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresight.session import cut_lineage

OFFSET_BITS = 33


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, Column], including: bool = False) -> DataFrame:
    """Adds each total over all rows before a row in ``order``, the row itself too if ``including``.

    Rows are range-partitioned; a total is the one inside the partition plus those of the partitions
    before it (one row a partition, hence the broadcast). The checkpoint keeps the placement fixed
    between the two readers.
    """
    given = {f"_of_{name}": column for name, column in totals.items()}
    placed = cut_lineage(
        df.withColumns(given)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_id", OFFSET_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy("_part")
        .agg(*[F.sum(f"_of_{name}").alias(f"_sum_{name}") for name in totals])
        .select("_part", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_from_{n}") for n in totals])
    )
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    summed = {n: F.coalesce(F.sum(f"_of_{n}").over(inside), F.lit(0)) + F.col(f"_from_{n}") for n in totals}
    helpers = [f"{kind}{name}" for name in totals for kind in ("_of_", "_from_")]
    return placed.join(F.broadcast(parts), "_part").withColumns(summed).drop("_part", "_id", *helpers)
