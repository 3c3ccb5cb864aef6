from __future__ import annotations

import numpy as np
import pytest
from conftest import snapshot_rows
from pyspark.sql import functions as F

from foresight import contract
from foresight.functions.labels import risk_tier, run_drift_label
from foresight.operators import drift, metrics
from foresight.operators.outputs import run_notes, with_customer_id


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip(map(float, y), map(float, p), strict=True)), "y double, p double")


@pytest.mark.parametrize(
    ("predicted", "field", "expected"),
    [
        ([50, 100, 150], "sales_mape", 0.125),
        ([10, 90, 180], "sales_wmape", 40 / 300),
        ([20, 80, 220], "sales_mae", 20.0),
    ],
)
def test_regression_vectors(spark, predicted, field, expected):
    row = metrics.regression_metrics(pairs(spark, [0, 100, 200], predicted), "y", "p").first()
    assert row[field] == pytest.approx(expected)


def test_regression_without_positive_actuals(spark):
    row = metrics.regression_metrics(pairs(spark, [0, 0], [1, 2]), "y", "p").first()
    assert (row["sales_mape"], row["sales_wmape"]) == (0.0, 0.0)


@pytest.mark.parametrize(
    ("y", "p"), [([10, 50, 20], [5, 12, 8]), ([0, 10, 1000], [0, 5, 950])]
)
def test_intervals(spark, y, p):
    df = pairs(spark, y, p)
    sigma = metrics.residual_sigma(df, "y", "p").first()[0]
    assert sigma == pytest.approx(np.std(np.subtract(y, p), ddof=1))
    for row in metrics.prediction_intervals(df, "p", sigma).collect():
        assert 0 <= row["sales_lower_bound"] <= row["p"] <= row["sales_upper_bound"]


def test_sigma_of_one_and_no_rows(spark):
    df = pairs(spark, [5], [2])
    assert metrics.residual_sigma(df, "y", "p").first()[0] == 0.0
    assert metrics.residual_sigma(df.limit(0), "y", "p").first()[0] == 1.0


def test_auc_and_confusion(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(500) < 0.2).astype(int)
    p = np.round(np.clip(0.3 * y + rng.random(500) * 0.7, 0, 1), 2)
    wins = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    df = pairs(spark, y, p)
    assert metrics.roc_auc(df, "y", "p") == pytest.approx(np.mean(wins), abs=1e-12)
    row = metrics.classification_metrics(df, "y", "p").first()
    called = p >= 0.5
    assert (row["tp"], row["fp"]) == ((called & (y == 1)).sum(), (called & (y == 0)).sum())
    assert row["brier_score"] == pytest.approx(np.mean((p - y) ** 2))
    assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == row["sample_count"] == 500


def test_single_class_and_no_calls(spark):
    df = pairs(spark, [0, 0], [0.1, 0.2])
    assert metrics.roc_auc(df, "y", "p") == 0.5
    row = metrics.classification_metrics(df, "y", "p").first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    queue = metrics.queue_statistics(df, "y", "p", 0.5).first()
    assert (queue["risk_queue_count"], queue["risk_queue_precision"], queue["risk_queue_lift"]) == (0, 0, 0)


def test_queue_includes_the_threshold(spark):
    df = pairs(spark, [1, 0, 1, 0], [0.9, 0.8, 0.2, 0.1])
    row = metrics.queue_statistics(df, "y", "p", 0.8).first()
    assert (row["risk_queue_count"], row["captured_churners"], row["risk_queue_recall"]) == (2, 1, 0.5)
    assert row["risk_queue_lift"] == pytest.approx(1.0)


def numpy_psi(base, target, bins=10, e=1e-4):
    edges = np.unique(np.percentile(base, np.linspace(0, 100, bins + 1)))
    if len(edges) < 2:
        edges = np.linspace(base.min() - 0.001, base.max() + 0.001, bins + 1)
    edges[0], edges[-1] = -np.inf, np.inf
    b, t = np.histogram(base, edges)[0], np.histogram(target, edges)[0]
    return smoothed(b, t, e)


def smoothed(b, t, e=1e-4):
    p, q = (b + e) / (b.sum() + len(b) * e), (t + e) / (t.sum() + len(t) * e)
    return max(0.0, float(np.sum((q - p) * np.log(q / p))))


def test_numeric_psi_matches_numpy(spark):
    rng = np.random.default_rng(5)
    n = 2000
    base = {
        "normal": rng.normal(size=n),
        "zeros": np.where(rng.random(n) < 0.95, 0.0, rng.random(n)),
        "flag": (rng.random(n) < 0.05).astype(float),
        "constant": np.full(n, 3.0),
        "small": rng.integers(0, 5, n).astype(float),
    }
    target = {
        "normal": rng.normal(0.4, 1.2, n),
        "zeros": np.where(rng.random(n) < 0.8, 0.0, rng.random(n)),
        "flag": (rng.random(n) < 0.11).astype(float),
        "constant": np.where(rng.random(n) < 0.1, 9.0, 3.0),
        "small": rng.integers(1, 7, n).astype(float),
    }
    names = list(base)

    def frame(columns):
        rows = [tuple(float(columns[c][i]) for c in names) for i in range(n)]
        return spark.createDataFrame([*rows, (None,) * len(names)], ", ".join(f"{c} double" for c in names))

    got = {r["feature"]: r["psi"] for r in drift.numeric_psi(frame(base), frame(target), names).collect()}
    for c in names:
        assert got[c] == pytest.approx(numpy_psi(base[c], target[c]), abs=1e-9), c
    assert got["flag"] == 0.0  # the de-duplicated deciles leave one bin


def test_categorical_psi_with_new_category(spark):
    base = spark.createDataFrame([(c,) for c in "aabbbc"], "x string")
    target = spark.createDataFrame([(c,) for c in "abbdd"] + [(None,)], "x string")
    row = drift.categorical_psi(base, target, ["x"]).first()
    assert row["psi"] == pytest.approx(smoothed(np.array([2, 3, 1, 0]), np.array([1, 2, 0, 2])))


def test_feature_psi_edges(spark):
    base = spark.createDataFrame([(1.0, 1, "a"), (2.0, 0, "b")], "seats double, flag int, plan_tier string")
    empty = base.limit(0)
    rows = drift.feature_psi(base, empty, ["seats", "flag", "plan_tier", "absent"]).collect()
    assert {r["feature"]: r["psi"] for r in rows} == {"seats": 0.0, "flag": 0.0, "plan_tier": 0.0}
    assert drift.numeric_features(base, base, ["seats", "flag", "plan_tier"]) == ["seats", "flag"]
    none = drift.aggregate_psi(drift.feature_psi(base, base, ["absent"])).first()
    assert (none["psi_score"], none["drift_flag"], none["calendar_aging"]) == (0.0, False, [])


def test_shift_raises_the_flag(spark, snapshot):
    shifted = snapshot.withColumns({c: F.col(c) * 25.0 + 1000.0 for c in contract.NUMERIC})
    by_feature = drift.feature_psi(snapshot, shifted)
    row = drift.aggregate_psi(by_feature).first()
    assert row["psi_score"] > 0.20 and row["drift_flag"] is True
    labels = {r["feature"]: r["label"] for r in by_feature.collect()}
    assert labels["account_age_days"] == "Expected Calendar Aging"
    assert labels["seats"] == "Critical Drift" and labels["industry"] == "Stable"
    assert row["calendar_aging"] == ["account_age_days", "active_tenure_days"]
    still = drift.aggregate_psi(drift.feature_psi(snapshot, snapshot)).first()
    assert (still["psi_score"], still["drift_flag"]) == (0.0, False)


def test_label_boundaries(spark):
    df = spark.createDataFrame([(0.0999,), (0.10,), (0.20,), (0.2001,)], "psi double")
    got = [r[0] for r in df.select(run_drift_label(F.col("psi"))).collect()]
    assert got == [
        "Stable (No Shift)",
        "Moderate Shift (Monitor)",
        "Moderate Shift (Monitor)",
        "Critical Drift (Action Required)",
    ]
    tiers = spark.createDataFrame(
        [(0.9, 0.9), (0.75, None), (0.5, None), (0.25, 0.9), (0.2499, None)], "p double, t double"
    )
    assert [r[0][:6] for r in tiers.select(risk_tier(F.col("p"), F.col("t"))).collect()] == [
        "Top-10",
        "Tier 1",
        "Tier 2",
        "Tier 3",
        "Tier 4",
    ]


def test_notes_and_generated_ids(spark):
    args = [F.lit(1.235), F.lit(0.3), F.lit(0.5), F.lit(3), F.lit(4), F.lit(2.0)]
    plain = spark.range(1).select(run_notes(*args, F.array().cast("array<string>"))).first()[0]
    assert "Residual sigma=1.24" in plain or "Residual sigma=1.23" in plain
    assert "captured 3/4 holdout churners (lift: 2.00x)." in plain and "calendar" not in plain
    aged = spark.range(1).select(run_notes(*args, F.array(F.lit("account_age_days")))).first()[0]
    assert aged.endswith("observed in account_age_days; treated as expected temporal drift.")
    ids = with_customer_id(spark.range(3).toDF("x"), ["x"]).orderBy("x").collect()
    assert [r["customer_id"] for r in ids] == ["CUST-00000", "CUST-00001", "CUST-00002"]
    with pytest.raises(ValueError):
        with_customer_id(spark.range(3).toDF("x"))


def test_snapshot_fixture_is_usable(spark):
    rows = snapshot_rows()
    assert len(rows) == 120 and 10 < sum(r["churn_next_30d"] for r in rows) < 110
