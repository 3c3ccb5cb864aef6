from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from conftest import CUTOFF
from pyspark.sql import functions as F

from foresight import contract
from foresight.operators import measures, quality, views
from foresight.plans.build import build_snapshots, run_snapshot_job
from foresight.plans.score import publish, run_scoring_job
from foresight.sources import raw as raw_source
from foresight.sources import store


def record(spark, **changes):
    base = {
        "run_id": "r1",
        "model_version": "v1",
        "churn_auc": 0.81234,
        "sales_mape": 0.1,
        "sales_rmse": 12.345,
        "psi_score": 0.25,
        "test_sample_count": 10,
    }
    base.update(changes)
    kept = {k: v for k, v in base.items() if v is not ...}
    return spark.createDataFrame([tuple(kept.values())], list(kept))


def prediction_rows(spark, *changes):
    base = {
        "customer_id": "C",
        "actual_churn": 0,
        "churn_probability": 0.5,
        "actual_sales": 10.0,
        "predicted_sales": 10.0,
        "sales_lower_bound": 5.0,
        "sales_upper_bound": 15.0,
        "prescriptive_action": "none",
        "prescribed_risk_drop": 0.4,
    }
    rows = [{**base, "customer_id": f"C{i}", **c} for i, c in enumerate(changes)]
    schema = (
        "customer_id string, actual_churn int, churn_probability double, actual_sales double,"
        " predicted_sales double, sales_lower_bound double, sales_upper_bound double,"
        " prescriptive_action string, prescribed_risk_drop double"
    )
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def broken(spark, **change):
    rows = quality.prepare_predictions(prediction_rows(spark, change), "r")
    return [r["rule"] for r in quality.violations(rows, quality.prediction_rules(), ["customer_id"]).collect()]


def test_csv_round_trip(spark, raw, tmp_path):
    for name, df in raw.items():
        df.write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    loaded = raw_source.load_raw(spark, str(tmp_path))
    for name, df in raw.items():
        assert sorted(loaded[name].collect(), key=str) == sorted(df.collect(), key=str), name
        assert loaded[name].schema.simpleString() == df.schema.simpleString()
    out = run_snapshot_job(spark, str(tmp_path), f"{tmp_path}/snap", [CUTOFF])
    direct = build_snapshots(*[raw[n] for n in contract.RAW_TABLES], [CUTOFF])
    assert out.columns == contract.SNAPSHOT_COLUMNS
    assert sorted(out.collect()) == sorted(direct.collect())


def test_missing_inputs_are_named(spark, raw, tmp_path):
    with pytest.raises(FileNotFoundError, match="accounts"):
        raw_source.load_raw(spark, str(tmp_path))
    given = raw_source.load_raw(spark, str(tmp_path), tables=raw)
    assert set(given) == set(contract.RAW_TABLES)
    with pytest.raises(FileNotFoundError):
        store.read_snapshots(spark, f"{tmp_path}/nothing")
    with pytest.raises(ValueError, match="usage_date"):
        raw_source.conform(raw["feature_usage"].drop("usage_date"), "feature_usage")


def test_snapshot_csv(spark, snapshot, tmp_path):
    path = store.write_snapshots(snapshot, f"{tmp_path}/csv", fmt="csv")
    back = store.read_snapshots(spark, path, fmt="csv")
    assert back.columns == contract.SNAPSHOT_COLUMNS and back.count() == snapshot.count()


def test_telemetry_required_and_derived(spark):
    with pytest.raises(ValueError, match="psi_score"):
        quality.prepare_telemetry(record(spark, psi_score=...))
    row = quality.prepare_telemetry(record(spark, run_id=...)).first()
    assert len(row["run_id"]) == 36 and row["drift_flag"] is True
    assert row["churn_auc"] == 0.8123 and row["notes"] == contract.DEFAULT_NOTES
    assert row["created_at"] is not None and row["sales_mae"] is None
    kept = quality.prepare_telemetry(record(spark, drift_flag=False, risk_threshold=0.123456)).first()
    assert kept["drift_flag"] is False and kept["risk_threshold"] == 0.123456


def test_telemetry_upsert(spark, tmp_path):
    path = f"{tmp_path}/telemetry"
    assert store.log_telemetry(spark, record(spark, notes="first", sales_mae=1.0), path) == ["r1"]
    store.log_telemetry(spark, record(spark, run_id="r2"), path)
    store.log_telemetry(
        spark, record(spark, churn_auc=0.9, psi_score=0.1, notes="second", model_version="v2"), path
    )
    rows = {r["run_id"]: r for r in spark.read.parquet(path).collect()}
    assert set(rows) == {"r1", "r2"}
    r1 = rows["r1"]
    assert (r1["churn_auc"], r1["psi_score"], r1["drift_flag"]) == (Decimal("0.9000"), Decimal("0.1000"), False)
    assert (r1["notes"], r1["model_version"], r1["sales_mae"]) == ("first", "v1", Decimal("1.00"))
    with pytest.raises(ValueError, match="churn_auc"):
        store.log_telemetry(spark, record(spark, churn_auc=1.5), path)


def test_prediction_rules(spark):
    assert broken(spark) == []
    assert broken(spark, churn_probability=1.5) == ["churn_probability out of range"]
    assert broken(spark, actual_churn=2) == ["actual_churn out of range"]
    assert broken(spark, actual_churn=None, actual_sales=None) == []  # null passes a range rule
    assert broken(spark, predicted_sales=-1.0) == ["predicted_sales out of range"]
    assert broken(spark, sales_lower_bound=20.0) == ["interval inverted"]
    assert broken(spark, prescriptive_action=None) == ["prescriptive_action is null"]
    assert broken(spark, prescribed_risk_drop=float("nan")) == ["prescribed_risk_drop is null"]
    assert broken(spark, actual_sales=12345678.0) == ["actual_sales overflows decimal(8,2)"]


def test_predictions_are_all_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/predictions"
    with pytest.raises(ValueError, match="empty"):
        store.log_predictions(spark, "r1", prediction_rows(spark, {}).limit(0), path)
    with pytest.raises(ValueError, match="customer_id"):
        store.log_predictions(spark, "r1", prediction_rows(spark, {}).drop("customer_id"), path)
    done = store.log_predictions(spark, "r1", prediction_rows(spark, *[{}] * 7), path, batch_size=3)
    assert (done["total_records"], done["batch_count"], done["status"]) == (7, 3, "success")
    with pytest.raises(ValueError, match="C1"):
        store.log_predictions(spark, "r2", prediction_rows(spark, {}, {"churn_probability": 2.0}), path)
    assert spark.read.parquet(path).select("run_id").distinct().collect()[0][0] == "r1"
    store.log_predictions(spark, "r1", prediction_rows(spark, {}, {}), path)  # a retry replaces
    store.log_predictions(spark, "r3", prediction_rows(spark, {}), path)
    stored = spark.read.parquet(path)
    assert {r["run_id"]: r["count"] for r in stored.groupBy("run_id").count().collect()} == {"r1": 2, "r3": 1}
    runs = spark.createDataFrame([("r1",)], "run_id string")
    assert [r["run_id"] for r in quality.orphans(stored, runs).collect()] == ["r3"]
    assert quality.without_runs(stored, runs).count() == 1


def test_delete_run_cascades(spark, tmp_path):
    telemetry, predictions = f"{tmp_path}/t", f"{tmp_path}/p"
    for run in ("r1", "r2"):
        store.log_telemetry(spark, record(spark, run_id=run), telemetry)
        store.log_predictions(spark, run, prediction_rows(spark, {}), predictions)
    store.delete_runs(spark, ["r1"], telemetry, predictions)
    for path in (telemetry, predictions):
        assert [r["run_id"] for r in spark.read.parquet(path).collect()] == ["r2"]


def test_key_reports(spark, raw):
    doubled = raw["accounts"].unionByName(raw["accounts"].filter("account_id = 'A1'"))
    assert [tuple(r) for r in quality.duplicate_keys(doubled, "account_id").collect()] == [("A1", 2)]
    with pytest.raises(ValueError, match="A1"):
        quality.require_unique(doubled, "account_id", "accounts")
    lost = quality.unknown_accounts(raw["subscriptions"], raw["accounts"].filter("account_id = 'A1'"))
    assert {r["subscription_id"] for r in lost.collect()} == {"S3", "S4", "S5"}


def serving(spark):
    runs = spark.createDataFrame(
        [
            ("old", "v1", 0.7, 0.1, 5.0, 0.05, False, 10, 0.90, datetime(2024, 1, 1)),
            ("new", "v2", 0.8, 0.1, 5.0, 0.15, True, 10, None, datetime(2024, 2, 1)),
        ],
        "run_id string, model_version string, churn_auc double, sales_mape double, sales_rmse double,"
        " psi_score double, drift_flag boolean, test_sample_count int, risk_threshold double, created_at timestamp",
    )
    telemetry = store.conform_columns(quality.prepare_telemetry(runs), contract.MODEL_TELEMETRY)
    levels = [0.25, 0.50, 0.75, 0.90]
    rows = prediction_rows(
        spark, *[{"churn_probability": p, "prescribed_risk_drop": d} for p in levels for d in (0.2, p)]
    )
    parts = [
        store.conform_columns(
            quality.prepare_predictions(rows, run).withColumn("created_at", F.lit(datetime(2024, 3, 1))),
            contract.CUSTOMER_PREDICTIONS,
        )
        for run in ("old", "new", "orphan")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), telemetry


def test_views(spark):
    predictions, telemetry = serving(spark)
    latest = views.latest_predictions(predictions, telemetry).collect()
    assert {r["run_id"] for r in latest} == {"new"} and len(latest) == 8
    by_p = {float(r["churn_probability"]): r["risk_tier"][:6] for r in latest}
    assert by_p == {0.25: "Tier 3", 0.5: "Tier 2", 0.75: "Tier 1", 0.9: "Tier 1"}
    assert sum(r["is_recoverable_revenue"] for r in latest) == 3  # p >= 0.5 with a lower risk after
    old = views.latest_predictions(predictions, telemetry.filter("run_id = 'old'")).collect()
    assert [r["risk_tier"] for r in old if r["churn_probability"] >= Decimal("0.9")] == [
        "Top-10% Operational Risk Queue"
    ] * 2
    queue = views.retention_queue(predictions, telemetry).collect()
    counts = {run: sum(r["run_id"] == run for r in queue) for run in ("old", "new", "orphan")}
    assert counts == {"old": 2, "new": 6, "orphan": 6}  # a run without telemetry uses 0.5
    losses = [r["expected_revenue_loss"] for r in queue]
    assert losses == sorted(losses, reverse=True)
    assert {r["run_id"] for r in views.retention_queue(predictions, telemetry, latest_only=True).collect()} == {"new"}
    governance = views.drift_governance(telemetry).collect()
    assert [r["run_id"] for r in governance] == ["new", "old"]
    assert governance[0]["drift_status_label"] == "Moderate Shift (Monitor)"
    views.create_views(predictions, telemetry)
    assert spark.sql("SELECT count(*) FROM latest_customer_predictions").first()[0] == 8


def test_measures_on_empty_and_small_input(spark):
    predictions, telemetry = serving(spark)
    latest = views.latest_predictions(predictions, telemetry)
    none = latest.limit(0)
    assert measures.systematic_sample(none, ["customer_id"], target=60).count() == 0
    assert measures.spend_deciles(none, ["customer_id"]).count() == 0
    empty = measures.exposure_at_cut(none).first()
    assert (empty["total_sales"], empty["at_risk_pct"], empty["recoverable_pct"]) == (0.0, 0.0, 0.0)
    assert measures.queue_measures(none, telemetry).first()["queue_selection_rate"] == 0.0
    sample = measures.systematic_sample(latest, ["customer_id"], target=3).collect()
    assert [r["subscriber_idx"] for r in sample] == ["Sub-1", "Sub-2", "Sub-3", "Sub-4"]  # 8 // 3 = 2
    both = measures.drift_status_text(telemetry).first()[0]
    one = measures.drift_status_text(telemetry.filter("run_id = 'new'")).first()[0]
    assert "STABLE" in both and "CRITICAL" in one
    assert measures.search_customers(latest, " c1 ").count() == 1
    assert measures.search_customers(latest, "^c[12]$", regex=True).count() == 2
    assert measures.run_header(telemetry).first()["psi_score"] == 0.15


def test_scoring_job_to_published_run(spark, snapshot, tmp_path):
    from foresight.models.churn import ChurnModel

    path = store.write_snapshots(snapshot, f"{tmp_path}/snapshots")
    run = run_scoring_job(
        spark, path, f"{tmp_path}/out", churn_model=ChurnModel({"maxIter": 2}, folds=2)
    )
    done = publish(spark, run, f"{tmp_path}/telemetry", f"{tmp_path}/predictions")
    assert done["total_records"] == 60 and done["batch_count"] == 1
    exported = spark.read.option("header", True).csv(f"{tmp_path}/out/customer_predictions")
    again = spark.read.option("header", True).csv(f"{tmp_path}/out/predictions_holdout")
    assert exported.count() == 60 and sorted(exported.collect()) == sorted(again.collect())
    assert spark.read.json(f"{tmp_path}/out/model_telemetry").count() == 1
    latest = views.latest_predictions(
        spark.read.parquet(f"{tmp_path}/predictions"), spark.read.parquet(f"{tmp_path}/telemetry")
    )
    assert latest.count() == 60


def test_snapshots_are_gathered(spark, snapshot, tmp_path):
    """Few files a cutoff from many tasks, null and repeated cutoffs included; no draft is left behind."""
    odd = snapshot.withColumn("cutoff_date", F.to_date("cutoff_date"))
    gap = odd.limit(5).withColumn("cutoff_date", F.lit(None).cast("date"))
    rows = odd.union(odd).union(gap).repartition(60).persist()
    path = str(tmp_path / "snapshots")
    store.write_snapshots(rows, path)
    saved = store.read_snapshots(spark, path)
    assert sorted(map(str, saved.collect())) == sorted(map(str, rows.select(*saved.columns).collect()))
    folders = [f for f in (tmp_path / "snapshots").iterdir() if f.is_dir()]
    assert len(folders) == 3 and all(len(list(f.glob("*.parquet"))) <= 20 for f in folders)
    assert [f.name for f in tmp_path.iterdir()] == ["snapshots"]


def test_rows_of_a_contract_stay_neighbours(spark, tmp_path):
    """Gathering by a shuffle scatters neighbours, which then no longer pack well."""
    rows = spark.range(0, 60_000, numPartitions=4).selectExpr(
        "concat('s', id div 6) AS subscription_id", "date_add(date'2024-01-31', cast(id % 6 as int)) AS cutoff_date"
    )
    store.write_snapshots(rows, str(tmp_path / "t"))
    for day in (tmp_path / "t").glob("cutoff_date=*"):
        files = [[int(r[0][1:]) for r in spark.read.parquet(str(f)).collect()] for f in day.glob("*.parquet")]
        assert sum(map(len, files)) == 10_000
        assert sum(b != a + 1 for keys in files for a, b in zip(keys, keys[1:])) <= 3


def test_no_rows_leave_no_draft(spark, snapshot, tmp_path):
    store.write_snapshots(snapshot.limit(0), str(tmp_path / "none"))
    assert [f.name for f in tmp_path.iterdir()] == ["none"]
