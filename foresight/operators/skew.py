"""Joins to a unique-key table that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_FRACTION = 0.01
MOST_BROADCAST_RUNS = 100_000
MIN_SAMPLED_ROWS = 200
HOT_FACTOR = 4


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(
    df: DataFrame,
    key: str,
    fraction: float = SAMPLE_FRACTION,
    min_rows: int = MIN_SAMPLED_ROWS,
    seed: int = 17,
) -> list:
    """Keys that would fill a shuffle partition ``HOT_FACTOR`` times over, judged from a row sample.

    At most ``partitions / HOT_FACTOR`` keys can pass the share test, so the returned list is small
    however large the table is; None stands for missing keys. The sample only decides which keys are
    salted: a wrong guess costs balance, never rows.
    """
    share = min(0.5, HOT_FACTOR / shuffle_width(df.sparkSession))
    counts = (
        df.select(key)
        .sample(fraction, seed)
        .rollup(key)
        .agg(F.count("*").alias("n"), F.grouping(key).alias("is_total"))
    )
    largest = counts.filter(F.col("n") >= min_rows).orderBy(F.col("n").desc(), key)
    top = largest.limit(int(1 / share) + 1).collect()
    total = sum(row["n"] for row in top if row["is_total"])
    return [row[0] for row in top if not row["is_total"] and row["n"] >= share * total]


def _salt(key: Column, hot: Sequence, spread: Column, width: int) -> Column:
    """Rows of hot or null keys get a pseudo-random salt, all others salt 0."""
    hot_row = key.isNull() | F.coalesce(key.isin(list(hot)), F.lit(False))
    return F.when(hot_row, F.pmod(spread, F.lit(width))).otherwise(F.lit(0))


def join_runs(rows: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Join any number of rows to ``runs`` on ``run_id``, never shuffling a run's rows to one task.

    A run table of up to ``MOST_BROADCAST_RUNS`` rows, counted first, is broadcast; a longer one goes
    through ``join_unique``, which salts the large runs. Rows are the same either way.
    """
    width = runs.limit(MOST_BROADCAST_RUNS + 1).count()
    if width <= MOST_BROADCAST_RUNS:
        return rows.join(F.broadcast(runs), "run_id", how)
    if how == "left_anti":
        marked = join_unique(rows, runs.select("run_id").distinct().withColumn("_known", F.lit(True)), "run_id", "left")
        return marked.filter(F.col("_known").isNull()).drop("_known")
    return join_unique(rows, runs, "run_id", how)


def join_unique(
    fact: DataFrame,
    unique: DataFrame,
    key: str,
    how: str = "inner",
    hot: Sequence | None = None,
    spread: Sequence[str] = (),
) -> DataFrame:
    """Join ``fact`` to ``unique`` (one row per ``key``), spreading hot keys over all partitions.

    The sample scans the key column alone, once per build; pass ``hot`` to save it. Whichever keys
    are salted, the rows are the same: the switches above only decide balance.

    ``hot=None`` samples ``fact`` for hot keys; an empty list is a plain equi-join. Only the hot
    rows of ``unique`` are repeated, once per salt, so the other keys pay nothing. ``spread`` names
    the columns whose hash places a hot row, which keeps a retried task's output the same.
    """
    found = hot_keys(fact, key) if hot is None else list(hot)
    if not found:
        return fact.join(unique, key, how)
    keys = [k for k in found if k is not None]
    width = shuffle_width(fact.sparkSession)
    columns = list(spread) or [c for c, t in fact.dtypes if not t.startswith("map")]
    salted = fact.withColumn("_salt", _salt(F.col(key), keys, F.xxhash64(*columns), width))
    salts = F.when(
        F.col(key).isin(keys), F.sequence(F.lit(0), F.lit(width - 1)).cast("array<bigint>")
    ).otherwise(F.array(F.lit(0).cast("bigint")))
    repeated = unique.withColumn("_salt", F.explode(salts))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
