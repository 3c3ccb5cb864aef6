from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from conftest import CUTOFF, at
from pyspark.sql import functions as F

from foresight import contract
from foresight.functions.dates import month_end_frame, month_ends, whole_days
from foresight.functions.flags import flag
from foresight.operators import spine, support, usage
from foresight.operators.leakage import audit_leakage, leakage_violations
from foresight.plans.build import append_cohorts, build_snapshots


def by_id(df, key="subscription_id"):
    return {r[key]: r for r in df.collect()}


def build(raw, cutoffs=(CUTOFF,), **options):
    return build_snapshots(
        raw["accounts"],
        raw["subscriptions"],
        raw["feature_usage"],
        raw["support_tickets"],
        list(cutoffs),
        **options,
    )


def test_calendar(spark):
    defaults = month_ends()
    assert len(defaults) == 21 and defaults[0] == datetime(2023, 3, 31)
    assert datetime(2024, 2, 29) in defaults
    frame = [r[0] for r in month_end_frame(spark).orderBy("cutoff_date").collect()]
    assert frame == defaults
    assert month_ends("2024-01-31", "2024-01-30") == []


def test_active_and_targets(raw):
    active = spine.active_subscriptions(raw["subscriptions"], [CUTOFF])
    rows = by_id(spine.with_targets(active))
    assert set(rows) == {"S1", "S2", "S3"}
    assert {k: r["churn_next_30d"] for k, r in rows.items()} == {"S1": 1, "S2": 0, "S3": 0}
    assert rows["S1"]["future_mrr_30d"] == 0.0 and rows["S2"]["future_mrr_30d"] == 750.0


def test_forward_revenue_target(spark):
    rows = [
        ("S1", 100.0, at("2024-01-01"), at("2024-07-15")),
        ("S2", 250.0, at("2024-01-01"), at("2024-08-15")),
        ("S3", 500.0, at("2024-01-01"), None),
    ]
    schema = "subscription_id string, mrr_amount double, start_date timestamp_ntz, end_date timestamp_ntz"
    subs = spark.createDataFrame(rows, schema)
    targets = by_id(spine.with_targets(spine.active_subscriptions(subs, ["2024-06-30"])))
    assert [targets[k]["future_mrr_30d"] for k in ("S1", "S2", "S3")] == [0.0, 250.0, 500.0]


def test_target_boundaries(spark):
    c = datetime(2024, 6, 30)
    ends = {
        "at_cutoff": c,
        "just_after": c + timedelta(seconds=1),
        "at_horizon": c + timedelta(days=30),
        "past_horizon": c + timedelta(days=30, seconds=1),
    }
    rows = [(k, 10.0, datetime(2024, 1, 1), e) for k, e in ends.items()]
    rows.append(("starts_at_cutoff", 10.0, c, None))
    rows.append(("starts_after", 10.0, c + timedelta(seconds=1), None))
    schema = "subscription_id string, mrr_amount double, start_date timestamp_ntz, end_date timestamp_ntz"
    subs = spark.createDataFrame(rows, schema)
    got = by_id(spine.with_targets(spine.active_subscriptions(subs, [c])))
    assert {k: r["churn_next_30d"] for k, r in got.items()} == {
        "just_after": 1,
        "at_horizon": 1,
        "past_horizon": 0,
        "starts_at_cutoff": 0,
    }


def test_fixture_figures(raw):
    rows = by_id(build(raw))
    s1, s2, s3 = rows["S1"], rows["S2"], rows["S3"]
    assert (s1["usage_count_30d"], s1["error_count_30d"]) == (15, 1)
    assert (s1["usage_duration_secs_30d"], s1["unique_features_30d"]) == (900, 2)
    assert s1["usage_growth_14d_vs_prior14d"] == pytest.approx(5 / 6)
    assert s1["beta_feature_ratio_30d"] == pytest.approx(5 / 15)
    assert s2["usage_growth_14d_vs_prior14d"] == 0.0 and s3["usage_growth_14d_vs_prior14d"] == 0.0
    for s in (s1, s2):  # both subscriptions of the account
        assert s["ticket_count_60d"] == 2
        assert s["urgent_ticket_count_60d"] == 1 and s["escalation_count_60d"] == 1
        assert s["avg_resolution_time_hours_60d"] == 24.0
        assert s["avg_first_response_time_minutes_60d"] == 30.0
        assert s["avg_satisfaction_score_60d"] == 4.0
        assert s["satisfaction_response_count_60d"] == 1
    assert s3["ticket_count_60d"] == 0 and s3["avg_satisfaction_score_60d"] == 0.0
    assert (s3["is_trial"], s3["auto_renew_flag"], s3["industry"]) == (1, 0, "FinTech")
    assert s1["cutoff_date"] == date(2024, 6, 30)


def test_contract_columns(raw):
    df = build(raw)
    assert df.columns == contract.SNAPSHOT_COLUMNS and len(df.columns) == 30
    assert len(contract.NUMERIC) == 18 and len(contract.FEATURES) == 25
    assert not set(contract.PROHIBITED) & set(contract.FEATURES)
    assert not set(contract.CONTRACT_REVENUE) & set(contract.SALES_FEATURES)
    assert set(contract.MUTABLE) <= set(contract.FEATURES)


def test_hot_keys_do_not_change_the_table(raw):
    plain = build(raw, hot={"usage": [], "tickets": [], "subscriptions": []})
    salted = build(raw, hot={"usage": ["S1"], "tickets": ["A1"], "subscriptions": ["A1", "A2"]})
    assert sorted(plain.collect()) == sorted(salted.collect())


def test_cohorts_append_and_empty(raw):
    months = month_ends("2024-01-31", "2024-06-30")
    whole = build(raw, months)
    parts = append_cohorts(build(raw, months[:3]), build(raw, months[3:]))
    assert sorted(whole.collect()) == sorted(parts.collect())
    assert build(raw, [datetime(2023, 1, 31)]).count() == 0


def test_usage_window_edges(spark):
    c = datetime(2024, 6, 30)
    offsets = {"c": 0, "c14": 14, "c28": 28, "c28_late": 28.5, "c30": 30, "after": -0.5}
    events = [
        (f"U{k}", "S", c - timedelta(days=d), k, 1 + i, 10, 0, None)
        for i, (k, d) in enumerate(offsets.items())
    ]
    use = spark.createDataFrame(events, contract.FEATURE_USAGE)
    subs = spark.createDataFrame(
        [("S", at("2024-01-01"), None)],
        "subscription_id string, start_date timestamp_ntz, end_date timestamp_ntz",
    )
    row = usage.usage_aggregates(use, subs, [c]).first()
    assert row["usage_count"] == 1 + 2 + 3  # the candidate floor is 28 days, closed
    assert row["recent"] == 1  # (c-14d, c]
    assert row["prior"] == 2  # (c-28d, c-14d]
    assert row["beta_count"] is None
    documented = usage.usage_aggregates(use, subs, [c], floor_days=None).first()
    assert documented["usage_count"] == 1 + 2 + 3 + 4 + 5


def test_usage_guard_is_subscription_start(spark):
    c = datetime(2024, 6, 30)
    start = datetime(2024, 6, 20, 12)
    events = [
        ("U1", "S", start - timedelta(seconds=1), "a", 1, 1, 0, False),
        ("U2", "S", start, "b", 2, 1, 0, False),
        ("U3", "other", start, "b", 4, 1, 0, False),
    ]
    subs = spark.createDataFrame(
        [("S", start, None)],
        "subscription_id string, start_date timestamp_ntz, end_date timestamp_ntz",
    )
    rows = usage.usage_features(spark.createDataFrame(events, contract.FEATURE_USAGE), subs, [c]).collect()
    assert [r["usage_count_30d"] for r in rows] == [2.0]


def test_ticket_edges(spark):
    c = datetime(2024, 6, 30)
    signup = datetime(2024, 5, 10, 9, 30)
    low = c - timedelta(days=60)
    tickets = [
        ("at_cutoff", "A", c, c, 1.0, None, 0, 1.0, None),
        ("window_edge", "B", low, None, 2.0, "HIGH", None, 2.0, True),
        ("too_old", "B", low - timedelta(seconds=1), None, 2.0, "high", 5, 2.0, True),
        ("before_signup", "A", signup - timedelta(seconds=1), c, 8.0, "urgent", 1, 5.0, True),
        ("at_signup", "A", signup, c + timedelta(seconds=1), 9.0, "low", 1, 5.0, False),
        ("late_answer", "A", c - timedelta(minutes=10), None, 9.0, "low", 11, 5.0, False),
        ("answer_at_cutoff", "A", c - timedelta(minutes=10), None, 9.0, "low", 10, 5.0, False),
        ("unknown_account", "Z", c, c, 1.0, "urgent", 1, 1.0, True),
        ("no_signup", "N", c, c, 1.0, "urgent", 1, 1.0, True),
    ]
    accounts = spark.createDataFrame(
        [("A", signup), ("B", datetime(2020, 1, 1)), ("N", None)],
        "account_id string, signup_date timestamp_ntz",
    )
    df = spark.createDataFrame(tickets, contract.SUPPORT_TICKETS)
    rows = by_id(support.ticket_aggregates(df, accounts, [c]), "account_id")
    assert set(rows) == {"A", "B"}
    a, b = rows["A"], rows["B"]
    assert a["tickets"] == 4 and a["urgent"] == 0 and a["escalated"] == 0
    assert a["resolution_hours"] == 1.0 and a["satisfaction_responses"] == 1
    assert a["response_minutes"] == pytest.approx((0 + 1 + 10) / 3)
    assert (b["tickets"], b["urgent"], b["escalated"], b["resolution_hours"]) == (1, 1, 1, None)


def test_unknown_account_and_null_flags(spark, raw):
    lost = raw["subscriptions"].withColumn("account_id", F.lit("nobody")).withColumn(
        "auto_renew_flag", F.lit(None).cast("boolean")
    )
    row = build({**raw, "subscriptions": lost}).first()
    assert row["industry"] is None and row["account_age_days"] is None
    assert row["auto_renew_flag"] == 0 and row["ticket_count_60d"] == 0.0
    assert spark.range(1).select(flag(F.lit(None).cast("boolean"), True)).first()[0] is True


def test_days_are_elapsed_not_calendar(spark):
    df = spark.range(1).select(
        F.lit("2024-01-01 18:00:00").cast("timestamp_ntz").alias("a"),
        F.lit("2024-06-30 00:00:00").cast("timestamp_ntz").alias("b"),
    )
    got = df.select(whole_days(F.col("a"), F.col("b")), whole_days(F.col("b"), F.col("a"))).first()
    assert tuple(got) == (180, 0)


def test_whole_days_ignore_session_zone(spark):
    df = spark.range(1).select(
        F.lit("2024-03-01").cast("timestamp_ntz").alias("a"),
        F.lit("2024-03-31").cast("timestamp_ntz").alias("b"),
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(whole_days(F.col("a"), F.col("b"))).first()[0] == 30
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_leakage_audit(raw):
    df = build(raw)
    assert audit_leakage(df) is df
    with pytest.raises(ValueError, match="end_date"):
        audit_leakage(df.withColumn("end_date", F.lit(1)))
    with pytest.raises(ValueError, match="upgrade_flag"):
        audit_leakage(df, features=[*contract.FEATURES, "upgrade_flag"])
    assert leakage_violations(["churn_flag"]) == [("churn_flag", "dataset column")]


def test_revenue_target_resolution(spark):
    df = spark.createDataFrame([(1, 10.0, 3.0), (0, 20.0, 4.0)], "churn_next_30d int, mrr_amount double, x double")
    rebuilt, name = spine.resolve_sales_target(df)
    assert name == "future_mrr_30d" and [r[name] for r in rebuilt.collect()] == [0.0, 20.0]
    assert spine.resolve_sales_target(df, "x")[1] == "x"
    assert spine.resolve_sales_target(df.drop("churn_next_30d"))[1] == "mrr_amount"
    with pytest.raises(KeyError):
        spine.resolve_sales_target(df, "missing")
