"""Exact global ranks and quantiles without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresight.session import cut_lineage

SKETCH_ACCURACY = 10_000


def with_row_number(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str = "row_number",
    partitions: int | None = None,
) -> DataFrame:
    """1-based position of every row in the total order given by ``order``.

    Rows are range-partitioned and sorted per partition; a position is the row's place in its
    partition plus the sizes of the partitions before it. The checkpoint keeps the placement fixed
    between the job that counts partitions and the jobs that read the positions. ``order`` has to
    be unique per row for the result to be reproducible. ``partitions`` fixes their number.
    """
    sized = order if partitions is None else [partitions, *order]
    offset_bits = 33
    placed = cut_lineage(
        df.repartitionByRange(*sized)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_id", offset_bits))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )  # one row per partition: bounded by the shuffle width, hence the broadcast
    inside = F.col("_id") - F.shiftleft(F.col("_part"), offset_bits)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + inside + 1)
        .drop("_id", "_part", "_before")
    )


def ntile(position: Column, total: Column, buckets: int) -> Column:
    """SQL ``ntile`` from a 1-based position: the first ``total % buckets`` tiles are one larger."""
    size, larger = F.floor(total / buckets), total % buckets
    edge = larger * (size + 1)
    early = F.floor((position - 1) / (size + 1)) + 1
    late = larger + F.floor((position - 1 - edge) / F.greatest(size, F.lit(1))) + 1
    return F.when(position <= edge, early).otherwise(late).cast("int")


def _sketch(value: Column, probabilities: Sequence[float], accuracy: int) -> list[Column]:
    margin = 2.0 / accuracy
    targets = [max(0.0, p - margin) for p in probabilities] + [min(1.0, p + margin) for p in probabilities]
    return [
        F.count(value).alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.percentile_approx(value, targets, accuracy).alias("sketch"),
    ]


def as_arrays(columns: Sequence[Column]) -> Column:
    """The columns of a row as one array of doubles; missing and NaN values are null."""
    return F.array(*[F.nanvl(c.cast("double"), F.lit(None)) for c in columns])


def rows_of(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """An array column as a matrix, nulls as NaN."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _zone_counts(brackets: dict[int, tuple[np.ndarray, np.ndarray]], width: int):
    """Rows per column and zone; inside a bracket also per value. One pass, nothing is unfolded before it is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch, "x", width)
            found: list[tuple] = []
            for i, (low, high) in brackets.items():
                values = x[:, i]
                values = values[~np.isnan(values)]
                reached = np.searchsorted(low, values, side="right")
                passed = np.searchsorted(high, values, side="left")
                inside = reached > passed
                zones = reached + passed
                for zone, n in enumerate(np.bincount(zones[~inside])):
                    if n:
                        found.append((i, zone, None, int(n)))
                kept, counts = np.unique(values[inside], return_counts=True)
                own = np.searchsorted(low, kept, side="right") + np.searchsorted(high, kept, side="left")
                found += zip([i] * len(kept), own.tolist(), kept.tolist(), counts.tolist(), strict=True)
            types = [pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["column", "zone", "v", "c"]
            )

    return run


def column_quantiles(
    df: DataFrame, columns: Sequence[Column], probabilities: Sequence[float], group: str, accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """``exact_quantiles`` of several columns of a row; ``group`` is a column's place.

    The brackets (one row a column, from one wide aggregation) are looked up by binary search in a
    second pass, which sends on only counts and the few values inside a bracket. A column without values
    gives no row.
    """
    probs = [float(p) for p in probabilities]
    rows = df.select(as_arrays(columns).alias("x"))
    values = [F.get("x", F.lit(i)) for i in range(len(columns))]
    sketches = column_sketches(rows, values, probs, group, accuracy)
    found = sketches.collect()  # one row a column
    brackets = {
        r[group]: tuple(
            np.sort([r[extreme]] * len(probs) if r["n"] < accuracy else r["sketch"][part])
            for extreme, part in (("low", slice(None, len(probs))), ("high", slice(len(probs), None)))
        )
        for r in found
    }
    known = df.sparkSession.createDataFrame(
        [(r[group], r["n"], r["low"], r["high"]) for r in found], f"{group} int, n bigint, low double, high double"
    )
    cells = rows.mapInArrow(_zone_counts(brackets, len(columns)), "column int, zone int, v double, c bigint")
    counts = (
        cells.groupBy(F.col("column").alias(group), "zone", "v")
        .agg(F.sum("c").alias("c"))
        .join(F.broadcast(known), group)
    )
    return _ranked_quantiles(counts, group, probs)


def column_sketches(
    df: DataFrame, columns: Sequence[Column], probabilities: Sequence[float], group: str, accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Sketches of several columns in one row-wise aggregation; ``group`` is a column's place.

    Values must be doubles without NaN; a column without values gives no row.
    """
    folded = [x.alias(f"{x_name}{i}") for i, c in enumerate(columns)
              for x_name, x in zip("nlhs", _sketch(c, probabilities, accuracy), strict=True)]
    rows = F.array(
        *[
            F.struct(
                F.col(f"n{i}").alias("n"),
                F.col(f"l{i}").alias("low"),
                F.col(f"h{i}").alias("high"),
                F.col(f"s{i}").alias("sketch"),
            )
            for i in range(len(columns))
        ]
    )
    placed = df.agg(*folded).select(F.posexplode(rows).alias(group, "_x"))
    return placed.select(group, "_x.*").filter(F.col("n") > 0)


def exact_quantiles(
    df: DataFrame,
    group: str,
    value: str,
    probabilities: Sequence[float],
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """``(group, n, low, high, quantiles)`` with linearly interpolated exact quantiles.

    For a small, bounded number of groups (features, models) over any number of rows. A sketch first
    brackets every quantile; one pass then counts the rows outside the brackets and keeps only the
    distinct values inside them (about ``6 / accuracy`` of the rows each), which are ranked per
    bracket. No task ever holds a whole column, unlike a value-to-count ``percentile`` buffer.
    """
    probs = [float(p) for p in probabilities]
    indices = range(len(probs))
    numbers = F.nanvl(F.col(value).cast("double"), F.lit(None))  # NaN is a missing value
    values = df.select(group, numbers.alias("v")).filter(F.col("v").isNotNull())
    sketches = values.groupBy(group).agg(*_sketch(F.col("v"), probs, accuracy))
    # Sketches have one row per group, hence the broadcasts below.

    def bracket(extreme: str, i: int) -> Column:
        """A group too small for the margin to reach the next row is bracketed as a whole."""
        return F.when(F.col("n") < accuracy, F.col(extreme)).otherwise(F.get("sketch", F.lit(i)))

    brackets = sketches.select(
        group,
        "n",
        "low",
        "high",
        *[bracket("low", i).alias(f"lo{i}") for i in indices],
        *[bracket("high", len(probs) + i).alias(f"hi{i}") for i in indices],
    )
    v = F.col("v")

    def number_true(tests: list[Column]) -> Column:
        return F.coalesce(reduce(lambda a, b: a + b, [t.cast("int") for t in tests]), F.lit(0))

    reached = number_true([v >= F.col(f"lo{i}") for i in indices])
    passed = number_true([v > F.col(f"hi{i}") for i in indices])
    counts = (
        values.join(F.broadcast(brackets), group)
        .select(group, "n", "low", "high", "v", reached.alias("reached"), passed.alias("passed"))
        .groupBy(
            group,
            "n",
            "low",
            "high",
            (F.col("reached") + F.col("passed")).alias("zone"),
            F.when(F.col("reached") > F.col("passed"), v).alias("v"),  # inside some bracket
        )
        .agg(F.count("*").alias("c"))
    )
    return _ranked_quantiles(counts, group, probs)


def _ranked_quantiles(counts: DataFrame, group: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles from rows counted per zone: ``v`` is null between the brackets and the value inside one."""
    indices, v = range(len(probs)), F.col("v")
    zones_before = Window.partitionBy(group).orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)
    zones = (
        counts.groupBy(group, "zone")
        .agg(F.sum("c").alias("zone_rows"))
        .select(group, "zone", F.coalesce(F.sum("zone_rows").over(zones_before), F.lit(0)).alias("offset"))
    )  # at most 2 * len(probs) + 1 zones per group
    in_zone = Window.partitionBy(group, "zone").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # The rows between brackets (one per zone, v null) stay in: filtering them here would give the
    # two readers of ``counts`` different shuffles, and the data would be scanned twice.
    ranked = (
        counts.withColumn("inner", F.coalesce(F.sum("c").over(in_zone), F.lit(0)))
        .join(F.broadcast(zones), [group, "zone"])
        .withColumn("first", F.col("offset") + F.col("inner"))
    )

    def at_rank(rank: Column) -> Column:
        hit = (rank >= F.col("first")) & (rank < F.col("first") + F.col("c"))
        return F.max(F.when(hit, v))

    def found(name: str) -> Column:
        """A rank outside its bracket would leave a silent null behind."""
        return F.coalesce(F.col(name), F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))

    picks, quantiles = [], []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        picks += [at_rank(F.floor(position)).alias(f"a{i}"), at_rank(F.ceil(position)).alias(f"b{i}")]
        share = position - F.floor(position)
        quantiles.append(found(f"a{i}") + (found(f"b{i}") - found(f"a{i}")) * share)
    return (
        ranked.groupBy(group, "n", "low", "high")
        .agg(*picks)
        .select(group, "n", "low", "high", F.array(*quantiles).alias("quantiles"))
    )
