"""Contract reports, telemetry audit and quarantined input."""

from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresight import contract
from foresight.models.sales import Ridge, gram_matrix
from foresight.operators.reconcile import auc_by_run, reconcile, run_metrics
from foresight.operators.reports import (
    apply_candidate,
    mutability_report,
    prediction_report,
    required_report,
    split_report,
    telemetry_report,
)
from foresight.sources.raw import conform, read_quarantined, split_bad_rows


def verdicts(report):
    return {r.rule: (r.broken_rows, r.verdict) for r in report.collect()}


def test_required_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert verdicts(required_report(df, ["a", "b", "c"], "t")) == {
        "a given": (1, "broken"), "b given": (2, "broken"), "c given": (3, "broken"), "has rows": (0, "ok")
    }
    assert verdicts(required_report(df.limit(0), ["a", "c"], "t")) == {
        "a given": (0, "ok"), "c given": (1, "broken"), "has rows": (1, "broken")
    }
    assert verdicts(prediction_report(df))["customer_id given"] == (3, "broken")
    assert len(telemetry_report(df).collect()) == len(contract.REQUIRED_TELEMETRY) + 1


def test_split(spark):
    df = spark.createDataFrame([("2024-01-31",), ("2024-02-29",), ("2024-03-31",)], "cutoff_date string")
    early, late = df.filter("cutoff_date < '2024-03-01'"), df.filter("cutoff_date > '2024-03-01'")
    assert set(verdicts(split_report(early, late)).values()) == {(0, "ok")}
    assert verdicts(split_report(df, late))["train before holdout"] == (1, "broken")
    assert verdicts(split_report(early, late.limit(0)))["holdout has rows"] == (1, "broken")
    assert verdicts(split_report(early.limit(0), late))["train has rows"] == (1, "broken")
    bare = spark.createDataFrame([(1,)], "x int")
    assert set(verdicts(split_report(bare, bare)).values()) == {(0, "ok")}


def test_mutability(snapshot):
    good = {r.feature: r for r in mutability_report(snapshot).collect()}
    assert set(good) == set(contract.FEATURES) and {r.verdict for r in good.values()} == {"ok"}
    assert good["auto_renew_flag"].changed_rows > 0 and good["seats"].changed_rows == 0
    more = lambda df: apply_candidate(df).withColumn("industry", F.lit(None).cast("string"))
    bad = {r.feature: r for r in mutability_report(snapshot, change=more).collect()}
    assert bad["industry"].verdict == "broken" and bad["industry"].changed_rows > 0


RUNS = "run_id string, churn_auc double, sales_mae double, test_sample_count int, risk_threshold double"


def stored(spark):
    rng = random.Random(3)
    rows = []
    for run in ("a", "b", "one"):
        for i in range(200):
            y = 1 if run == "one" else int(rng.random() < 0.3)
            p = round(min(1, max(0, 0.3 * y + rng.random() * 0.7)), 1)  # many ties
            rows.append((run, y, p, float(rng.randrange(100)), float(rng.randrange(100))))
    return rows, spark.createDataFrame(
        rows, "run_id string, actual_churn int, churn_probability double, actual_sales double, predicted_sales double"
    )


def test_auc_against_all_pairs(spark):
    rows, predictions = stored(spark)
    found = {r.run_id: r.churn_auc for r in auc_by_run(predictions).collect()}
    for run in ("a", "b"):
        pos = [p for r, y, p, *_ in rows if r == run and y]
        neg = [p for r, y, p, *_ in rows if r == run and not y]
        won = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
        assert found[run] == pytest.approx(won / len(pos) / len(neg))
    assert found["one"] == 0.5


def test_reconcile(spark):
    _, predictions = stored(spark)
    runs = spark.createDataFrame([("a", 0.5), ("b", None), ("one", 0.2)], "run_id string, risk_threshold double")
    figures = run_metrics(predictions, runs)
    telemetry = figures.join(runs, "run_id")
    assert reconcile(telemetry, predictions).collect() == []
    by_run = {r.run_id: r for r in figures.collect()}
    assert by_run["b"].risk_queue_count is None and by_run["a"].risk_queue_count > 0
    tampered = telemetry.withColumns(
        {
            "sales_mae": F.when(F.col("run_id") == "a", F.col("sales_mae") + 1).otherwise(F.col("sales_mae")),
            "churn_auc": F.when(F.col("run_id") == "b", 0.999).otherwise(F.col("churn_auc")),
        }
    ).unionByName(telemetry.filter("run_id = 'a'").withColumn("run_id", F.lit("lost")))
    found = {(r.run_id, r.metric): r.recomputed for r in reconcile(tampered, predictions).collect()}
    assert {k for k in found if k[0] != "lost"} == {("a", "sales_mae"), ("b", "churn_auc")}
    assert len([k for k in found if k[0] == "lost"]) == 10 and found["lost", "sales_mae"] is None
    assert reconcile(telemetry.limit(0), predictions).collect() == []


def test_bad_values_are_set_aside(spark, tmp_path):
    header = "usage_id,subscription_id,usage_date,feature_name,usage_count,usage_duration_secs,error_count,is_beta_feature,note"
    lines = [
        "U1,S1,2024-06-25,f,10.0,600,1,false,fine",
        "U2,S1,yesterday,f,5,300,0,true,bad date",
        "U3,S1,2024-06-25,f,5.5,300,x,true,two faults",
        "U4,S1,2024-06-25,f,,300,0,maybe,bad flag",
        "U5,S1,,f,,,,,nulls are no fault",
    ]
    (tmp_path / "feature_usage.csv").write_text("\n".join([header, *lines]))
    good, bad = read_quarantined(spark, str(tmp_path), "feature_usage")
    assert {f.name: f.dataType for f in good.schema} == {f.name: f.dataType for f in contract.FEATURE_USAGE}
    rows = {r.usage_id: r for r in good.collect()}
    assert set(rows) == {"U1", "U5"} and rows["U1"].usage_count == 10
    assert rows["U1"].usage_date == datetime(2024, 6, 25)
    faults = {r.usage_id: (r.bad_columns, r.note) for r in bad.collect()}
    assert faults == {
        "U2": (["usage_date"], "bad date"),
        "U3": (["usage_count", "error_count"], "two faults"),
        "U4": (["is_beta_feature"], "bad flag"),
    }
    whole = conform(spark.read.option("header", True).csv(f"{tmp_path}/feature_usage.csv").filter("usage_id = 'U1'"), "feature_usage")
    assert whole.collect() == good.filter("usage_id = 'U1'").collect()
    assert split_bad_rows(good.limit(0), "feature_usage")[1].count() == 0
    with pytest.raises(ValueError, match="lacks columns: usage_date"):
        split_bad_rows(good.drop("usage_date"), "feature_usage")


def test_ridge_solves_the_normal_equations(spark):
    rng = np.random.default_rng(1)
    x, alpha = rng.normal(size=(80, 4)), 2.5
    y = x @ [1.0, -2.0, 0.5, 0.0] + 7 + rng.normal(size=80)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)] + [([1.0] * 4, None)], "x array<double>, y double")
    fitted = Ridge.solve(gram_matrix(df.repartition(5)), alpha)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    weights = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
    assert fitted.weights == pytest.approx(weights) and fitted.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ weights)
    plain = Ridge.solve(gram_matrix(df), 0.0)
    assert np.abs(xc @ plain.weights - yc).sum() <= np.abs(xc @ weights - yc).sum() + 1
    with pytest.raises(ValueError, match="no row with a target"):
        gram_matrix(df.limit(0))
