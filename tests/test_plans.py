"""Properties of the physical plans that decide whether they scale."""

from __future__ import annotations

from pathlib import Path

import pytest

from checks import q_features, testbed
from foresight.operators import drift, usage, views
from foresight.plans.build import build_snapshots

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not present")
NO_HOT = {"usage": [], "tickets": [], "subscriptions": []}


@pytest.fixture
def large(spark):
    """Plans as for inputs beyond the broadcast threshold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def snapshot_plan(spark) -> str:
    raw = testbed.raw(spark, SF_DIR)
    return plan(build_snapshots(*raw.values(), testbed.CUTOFFS, hot=NO_HOT))


def test_snapshots_join_at_entity_grain(large):
    text = snapshot_plan(large)
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "BroadcastExchange" not in text  # nothing that grows is broadcast
    top = text.split("SortMergeJoin")[0]
    assert "Generate explode" in top and "Exchange" not in top  # cutoffs fan out after the last join


def test_usage_scan_is_pruned_and_filtered(large):
    raw = testbed.raw(large, SF_DIR)
    figures = usage.usage_aggregates(raw["feature_usage"], raw["subscriptions"], testbed.CUTOFFS, hot=[])
    text = figures._jdf.queryExecution().explainString(
        large._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    scan = next(p for p in text.split("\n\n") if "Scan parquet" in p and "l_shipdate" in p and "ReadSchema" in p)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThanOrEqual(l_shipdate" in scan
    assert "l_tax" not in scan and "l_returnflag" not in scan


def test_usage_needs_one_shuffle_per_side(large):
    raw = testbed.raw(large, SF_DIR)
    figures = usage.usage_aggregates(raw["feature_usage"], raw["subscriptions"], testbed.CUTOFFS, hot=[])
    assert plan(figures).count("Exchange hashpartitioning") == 2  # events and contracts


def test_drift_shares_its_count_shuffle(spark):
    df = q_features.snapshots(spark, SF_DIR, testbed.CUTOFFS[:2])
    edges = drift.decile_edges(df, ["seats", "mrr_amount"])
    edges.collect()
    assert "ReusedExchange" in plan(edges)


def test_latest_view_broadcasts_one_row(large):
    predictions, telemetry = testbed.predictions(large, SF_DIR), testbed.telemetry(large, SF_DIR)
    text = plan(views.latest_predictions(predictions, telemetry))
    assert "BroadcastHashJoin" in text and "TakeOrderedAndProject(limit=1" in text
