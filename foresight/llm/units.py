"""Groups of candidates dealt as work units of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresight.llm.workspace import Workspace

#: A group above this size is split into blocks of about half of it.
UNIT_ROWS = 4096


def dealt(
    rows: DataFrame,
    key: str,
    spread: str,
    space: Workspace,
    unit_rows: int = UNIT_ROWS,
    weight: str | None = None,
    unit_weight: int = 0,
) -> DataFrame:
    """Deal rows of a key into units that a task can hold, losing no pair of rows of that key.

    A key with more than ``unit_rows`` rows, or whose ``weight`` sums to more than ``unit_weight``, is
    cut into blocks by the hash of ``spread``, and every pair of blocks becomes a unit, as does every
    block by itself. Columns ``lo`` and ``hi`` name the unit's blocks and ``side`` the row's own one
    (0: lo). Pairs within a block belong to its own unit (lo = hi), pairs across blocks to theirs.
    """
    size, blocks = F.col("n") > unit_rows, F.ceil(F.col("n") / (unit_rows // 2))
    sums = [F.count("*").alias("n")]
    if weight is not None:
        sums.append(F.sum(weight).alias("w"))
        size |= F.col("w") > unit_weight
        blocks = F.greatest(blocks, F.least("n", F.ceil(F.col("w") / (unit_weight // 2))))
    large = space.put(
        rows.groupBy(key).agg(*sums).filter(size).select(F.col(key).alias("_key"), blocks.cast("int").alias("_blocks")),
        f"large-{key}",
    )  # few or no keys: its known size lets Spark broadcast it, or else join by shuffles
    split = rows.join(large, rows[key] == large["_key"], "left").drop("_key")
    block = F.pmod(F.xxhash64(spread, F.lit(7)), F.col("_blocks").cast("bigint")).cast("int")
    others = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("_blocks") - 1)
    )
    return (
        split.withColumn("_own", F.coalesce(block, F.lit(0)))
        .withColumn("_other", F.explode(others))
        .withColumn("lo", F.least("_own", "_other"))
        .withColumn("hi", F.greatest("_own", "_other"))
        .withColumn("side", (F.col("_own") != F.col("lo")).cast("int"))
        .drop("_own", "_other", "_blocks")
    )


def together(rows: DataFrame, key: str, spread: str) -> DataFrame:
    """Dealt rows sorted, units one after the other."""
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "side", spread)


def in_units(
    rows: DataFrame, key: str, spread: str, space: Workspace, unit_rows: int = UNIT_ROWS
) -> DataFrame:
    """``dealt`` and ``together``."""
    return together(dealt(rows, key, spread, space, unit_rows), key, spread)


def _column(array: pa.Array) -> np.ndarray:
    if pa.types.is_list(array.type):
        flat = array.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)
    return array.to_numpy(zero_copy_only=False)


def units(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict, np.ndarray]]:
    """Arrays of the columns with the bounds of the whole units of two rows or more in them."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: _column(batch.column(c)) for c in batch.schema.names}
        data = {c: np.concatenate([held[c], new[c]]) for c in new} if held else new
        n = len(data[key])
        changed = np.zeros(n, dtype=bool)
        changed[0] = True
        for c in (key, "lo", "hi"):
            changed[1:] |= data[c][1:] != data[c][:-1]
        starts = np.flatnonzero(changed)
        held = {c: x[starts[-1] :] for c, x in data.items()}
        yield from _whole(data, starts)
    if held:
        yield from _whole(held, np.array([0, len(held[key])]))


def _whole(data: dict, edges: np.ndarray) -> Iterator[tuple[dict, np.ndarray]]:
    bounds = np.stack([edges[:-1], edges[1:]], axis=1)
    bounds = bounds[bounds[:, 1] - bounds[:, 0] > 1]
    if len(bounds):
        yield data, bounds
