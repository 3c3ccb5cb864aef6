"""Cases that once went wrong: typed split dates, NaN, empty calendars, number text, run joins."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from foresight.functions.dates import cutoffs_near, month_ends, ntz
from foresight.operators import quality, skew, views
from foresight.operators.drift import feature_psi
from foresight.operators.ranking import exact_quantiles
from foresight.operators.split import split_by_position, temporal_split
from foresight.operators.support import ticket_aggregates
from foresight.operators.usage import usage_aggregates, usage_candidates
from foresight.sources.raw import conform
from foresight.sources.store import log_telemetry, write_snapshots


@pytest.fixture(scope="module")
def dated(spark):
    rows = [(i, date(2024, 5, 31) if i < 6 else date(2024, 6, 30)) for i in range(8)]
    return spark.createDataFrame(rows, "subscription_id int, cutoff_date date")


@pytest.mark.parametrize("edge", [datetime(2024, 6, 30), date(2024, 6, 30), "2024-06-30"])
def test_split_at_the_last_cutoff_is_by_date(dated, edge):
    train, holdout = temporal_split(dated, edge, order_cols=["subscription_id"])
    assert (train.count(), holdout.count()) == (6, 2)


@pytest.mark.parametrize("edge", [datetime(2024, 5, 31), date(2024, 5, 31), datetime(2025, 1, 1)])
def test_split_that_empties_a_side_falls_back(dated, edge):
    train, holdout = temporal_split(dated, edge, test_ratio=0.25, order_cols=["subscription_id"])
    assert sorted(r[0] for r in holdout.collect()) == [6, 7] and train.count() == 6


def test_split_by_position_cuts_between_keys(spark):
    rows = [(None, "b"), (1, None), (1, "a"), (2, "z"), (0, "x")]
    df = spark.createDataFrame(rows, "k int, t string")
    train, holdout = split_by_position(df, ["k", "t"], test_ratio=0.4)
    assert {tuple(r) for r in train.collect()} == {(None, "b"), (0, "x"), (1, None)}
    assert {tuple(r) for r in holdout.collect()} == {(1, "a"), (2, "z")}


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    base = spark.createDataFrame([(float(i), nan if i % 10 == 0 else float(i)) for i in range(1, 401)], "a double, b double")
    target = spark.createDataFrame([(float(i), float(i)) for i in range(1, 401) if i % 10], "a double, b double")
    scores = {r["feature"]: r["psi"] for r in feature_psi(base, target, ["a", "b"], ["a", "b"]).collect()}
    assert scores["b"] == 0.0
    melted = base.select(F.lit(0).alias("g"), "b")
    row = exact_quantiles(melted, "g", "b", [0.0, 1.0]).first()
    assert (row["n"], row["low"], row["high"], row["quantiles"]) == (360, 1.0, 399.0, [1.0, 399.0])


def test_empty_calendar(raw):
    assert usage_aggregates(raw["feature_usage"], raw["subscriptions"], [], hot=[]).count() == 0
    assert ticket_aggregates(raw["support_tickets"], raw["accounts"], [], hot=[]).count() == 0


def test_floor_of_zero_days_keeps_only_the_cutoff_itself(raw):
    cutoffs = ["2024-06-25", "2024-06-26"]
    found = usage_candidates(raw["feature_usage"], cutoffs, floor_days=0)
    assert [(r.usage_id, str(r.cutoff_date.date())) for r in found.collect()] == [("U1", "2024-06-25")]


def test_calendar_part_covers_every_cutoff_in_reach(spark):
    cutoffs = month_ends("2023-01-31", "2024-12-31")
    days = spark.sql("SELECT explode(sequence(date'2022-11-15', date'2025-02-10', interval 3 days)) AS d")
    low = F.col("d").cast("timestamp_ntz")
    rows = days.select("d", cutoffs_near(cutoffs, low, low + F.expr("INTERVAL 28 DAYS")).alias("part")).collect()
    for r in rows:
        start = datetime(r.d.year, r.d.month, r.d.day)
        want = {c for c in cutoffs if 0 <= (c - start).days <= 28}
        assert want <= set(r["part"]) and len(r["part"]) <= 3
    open_end = days.select(F.size(cutoffs_near(cutoffs, ntz("2024-11-05"), F.lit(None).cast("timestamp_ntz")))).first()[0]
    assert open_end == 2


def test_whole_numbers_written_with_a_point(spark):
    columns = ["usage_id", "subscription_id", "usage_date", "feature_name", "usage_count",
               "usage_duration_secs", "error_count", "is_beta_feature"]
    text = ", ".join(f"{c} string" for c in columns)
    good = spark.createDataFrame([("u", "s", "2024-01-01", "f", "30.0", "1e2", None, "true")], text)
    row = conform(good, "feature_usage").first()
    assert (row.usage_count, row.usage_duration_secs, row.error_count) == (30, 100, None)
    bad = spark.createDataFrame([("u", "s", "2024-01-01", "f", "30.5", "1", "1", "true")], text)
    with pytest.raises(Exception, match="usage_count is not a whole number: 30.5"):
        conform(bad, "feature_usage").collect()


def test_a_batch_may_name_a_run_once(spark, tmp_path):
    row = ("r1", "v", 0.8, 0.1, 9.0, 0.05, 10)
    schema = (
        "run_id string, model_version string, churn_auc double, sales_mape double, sales_rmse double, "
        "psi_score double, test_sample_count int"
    )
    twice = spark.createDataFrame([row, row], schema)
    with pytest.raises(ValueError, match="r1 more than once"):
        log_telemetry(spark, twice, str(tmp_path / "runs"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def runs_and_rows(spark):
    rows = spark.createDataFrame([(f"r{i % 3}", i) for i in range(30)], "run_id string, n int")
    return rows, spark.createDataFrame([("r0", 0.5), ("r1", None)], "run_id string, risk_threshold double")


def test_rows_are_not_shuffled_by_run(spark, no_broadcast, monkeypatch):
    rows, runs = runs_and_rows(spark)
    for joined, n in ((skew.join_runs(rows, runs, "left"), 30), (quality.orphans(rows, runs), 10)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(run_id" not in plan and joined.count() == n
    monkeypatch.setattr(skew, "MOST_BROADCAST_RUNS", 1)
    assert skew.join_runs(rows, runs, "left").count() == 30
    assert {r.run_id for r in quality.orphans(rows, runs).collect()} == {"r2"}


def test_unknown_accounts_with_hot_keys(spark):
    subs = spark.createDataFrame([(i, "hot" if i < 90 else f"a{i}") for i in range(100)], "s int, account_id string")
    accounts = spark.createDataFrame([("hot",), ("a95",)], "account_id string")
    assert sorted(r.s for r in quality.unknown_accounts(subs, accounts).collect()) == [90, 91, 92, 93, 94, 96, 97, 98, 99]


def test_dashboard_has_no_cap_of_its_own(spark):
    import inspect

    assert inspect.signature(views.dashboard_rows).parameters["cap"].default is None


def test_snapshot_files_stay_few(spark, tmp_path, snapshot):
    spread = snapshot.withColumn("cutoff_date", F.col("cutoff_date").cast("date")).repartition(16)
    write_snapshots(spread, str(tmp_path / "s"))
    files = [p for p in (tmp_path / "s").rglob("*.parquet")]
    assert len(files) <= 2 * spread.select("cutoff_date").distinct().count()
