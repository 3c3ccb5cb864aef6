from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresight.operators.ranking import exact_quantiles, ntile, with_row_number
from foresight.operators.skew import hot_keys, join_unique
from foresight.operators.split import split_by_position, temporal_split

PROBS = [i / 10 for i in range(11)]


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_quantiles_match_numpy(spark, accuracy):
    """Low accuracies make narrow samples go through the bracketed path."""
    rng = np.random.default_rng(3)
    columns = {
        "normal": rng.normal(size=5000),
        "zeros": np.where(rng.random(5000) < 0.95, 0.0, rng.random(5000)),
        "small": rng.integers(0, 7, 5000).astype(float),
        "constant": np.full(5000, 4.25),
        "skewed": np.exp(rng.normal(size=5000) * 3),
        "tiny": np.array([3.0, 1.0, 2.0]),
        "single": np.array([7.5]),
    }
    rows = [(k, float(v)) for k, values in columns.items() for v in values] + [("normal", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "feature string, value double").repartition(5)
    got = {r["feature"]: r for r in exact_quantiles(df, "feature", "value", PROBS, accuracy).collect()}
    assert set(got) == set(columns)
    for name, values in columns.items():
        expected = np.quantile(values, PROBS)
        assert np.allclose(got[name]["quantiles"], expected, rtol=1e-12, atol=1e-12), name
        assert got[name]["n"] == len(values)


def test_row_numbers_and_tiles(spark):
    n = 1003
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.lit("x").alias("x"))
    ranked = with_row_number(df.repartition(7), ["k"], "rn")
    assert ranked.filter(F.col("rn") != F.col("k") + 1).count() == 0
    tiles = ranked.withColumn("t", ntile(F.col("rn"), F.lit(n), 10))
    ranked.createOrReplaceTempView("ranked")
    window = spark.sql("SELECT k, ntile(10) OVER (ORDER BY rn) AS w FROM ranked")
    assert tiles.join(window, "k").filter("t <> w").count() == 0
    few = with_row_number(spark.range(4).toDF("k"), ["k"], "rn")
    got = few.select(ntile(F.col("rn"), F.lit(4), 10)).collect()
    assert sorted(r[0] for r in got) == [1, 2, 3, 4]


def skewed(spark, n=60_000):
    """A third of the rows share one key, some have none."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 997 + 100)
    return spark.range(n).select("id", key.cast("long").alias("k"))


def test_hot_keys_found(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert hot_keys(skewed(spark), "k", fraction=0.1) == [7]
        mostly_missing = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
        assert hot_keys(mostly_missing, "k", fraction=0.1) == [None]
        assert hot_keys(skewed(spark, 300), "k") == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("hot", [[7, 99999], [None], [None, 7]])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain(spark, how, hot):
    fact = skewed(spark, 6000)
    unique = spark.range(0, 600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = fact.join(unique, "k", how).select("id", "k", "v")
    salted = join_unique(fact, unique, "k", how, hot=hot).select("id", "k", "v")
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def test_salting_spreads_the_hot_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        unique = spark.range(0, 2000).select(F.col("id").alias("k"))
        joined = join_unique(skewed(spark), unique, "k", hot=[7], spread=["id"])
        sizes = [len(p) for p in joined.filter("k = 7").rdd.glom().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 20_000 / 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_split_rules(spark):
    days = [f"2024-{m:02d}-28" for m in range(1, 11)]
    df = spark.createDataFrame([(i, days[i % 10]) for i in range(50)], "id long, cutoff_date string")
    train, rest = temporal_split(df)
    assert {r[0] for r in rest.select("cutoff_date").distinct().collect()} == set(days[8:])
    assert train.count() + rest.count() == 50
    train, rest = temporal_split(df, split_date=days[3])
    assert train.count() == 15 and rest.count() == 35
    train, rest = temporal_split(df, split_date="2030-01-01", order_cols=["id"])  # empty side
    assert ids(train) == list(range(40))
    one = df.filter(F.col("cutoff_date") == days[0])
    train, rest = temporal_split(one, order_cols=["id"])
    assert ids(train) == [0, 10, 20, 30] and ids(rest) == [40]
    train, rest = temporal_split(df.drop("cutoff_date"), order_cols=["id"])
    assert ids(rest) == list(range(40, 50))
    train, rest = split_by_position(df.limit(1), ["id"])
    assert train.count() == 1 and rest.count() == 0
    with pytest.raises(ValueError):
        temporal_split(one)


def test_default_calendar_split_is_16_to_5(spark):
    from foresight.functions.dates import month_ends

    df = spark.createDataFrame([(str(c)[:10],) for c in month_ends()], "cutoff_date string")
    train, rest = temporal_split(df)
    assert (train.count(), rest.count()) == (16, 5)


def test_stored_frames_are_built_once(spark):
    """Readers of a stored frame see one build, and a reader of one column reads no other."""
    from foresight.session import stored

    built = stored(spark.range(100).selectExpr("id", "rand() AS r", "cast(id AS string) AS s"))
    assert built.agg({"r": "sum"}).first() == built.agg({"r": "sum"}).first()
    plan = built.select("id").filter("id > 90")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "GreaterThan(id,90)" in plan
