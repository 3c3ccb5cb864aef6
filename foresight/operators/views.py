"""Serving views over the stored telemetry and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresight import contract
from foresight.functions.labels import risk_tier, run_drift_label
from foresight.operators.skew import join_runs

# Columns of the run views.
RUN_COLUMNS = [
    "run_id",
    "model_version",
    "churn_auc",
    "sales_mape",
    "sales_rmse",
    "sales_mae",
    "sales_wmape",
    "psi_score",
    "drift_flag",
    "risk_threshold",
    "risk_queue_lift",
]


def latest_run(telemetry: DataFrame) -> DataFrame:
    """The newest run; the larger ``run_id`` wins when two share a time."""
    return (
        telemetry.orderBy(F.col("created_at").desc_nulls_first(), F.col("run_id").desc())
        .limit(1)
        .select(*RUN_COLUMNS, F.col("created_at").alias("run_timestamp"))
    )


def latest_predictions(predictions: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Predictions of the newest run with its telemetry, risk tier and recoverability."""
    p, after, threshold = (
        F.col(c) for c in ("churn_probability", "prescribed_risk_drop", "risk_threshold")
    )
    cut = F.coalesce(threshold.cast("double"), F.lit(contract.DECISION_THRESHOLD))
    joined = predictions.join(F.broadcast(latest_run(telemetry)), "run_id")  # exactly one row
    ids = [c for c in ("subscription_id", "cutoff_date") if c in predictions.columns]
    return joined.select(
        *RUN_COLUMNS,
        "run_timestamp",
        "customer_id",
        *ids,
        "actual_churn",
        "churn_probability",
        risk_tier(p, threshold).alias("risk_tier"),
        "actual_sales",
        "predicted_sales",
        "sales_lower_bound",
        "sales_upper_bound",
        (F.col("sales_upper_bound") - F.col("sales_lower_bound")).alias("interval_spread"),
        "prescriptive_action",
        "prescribed_risk_drop",
        (p - after).alias("risk_reduction_delta"),
        F.coalesce((p >= cut) & (after < p), F.lit(False)).alias("is_recoverable_revenue"),
        F.col("created_at").alias("prediction_timestamp"),
    )


def dashboard_rows(
    predictions: DataFrame,
    telemetry: DataFrame,
    order_cols: Sequence[str] = ("customer_id",),
    cap: int | None = None,
) -> DataFrame:
    """The newest run in order; ``cap`` keeps only its first rows, the same ones every time."""
    rows = latest_predictions(predictions, telemetry).orderBy(*order_cols)
    return rows if cap is None else rows.limit(cap)


def drift_governance(telemetry: DataFrame) -> DataFrame:
    """Every run with its drift label, newest first."""
    return telemetry.select(
        *RUN_COLUMNS[:10],
        "risk_queue_count",
        "risk_queue_recall",
        "risk_queue_precision",
        "risk_queue_lift",
        run_drift_label(F.col("psi_score")).alias("drift_status_label"),
        "test_sample_count",
        "notes",
        F.col("created_at").alias("run_timestamp"),
    ).orderBy(F.col("run_timestamp").desc(), F.col("run_id").desc())


def retention_queue(
    predictions: DataFrame, telemetry: DataFrame, latest_only: bool = False
) -> DataFrame:
    """Queued customers of all runs (or the newest), by expected revenue loss."""
    runs = telemetry.select("run_id", "risk_threshold")
    if latest_only:
        predictions = predictions.join(
            F.broadcast(latest_run(telemetry).select("run_id")), "run_id", "left_semi"
        )
    p, after = F.col("churn_probability"), F.col("prescribed_risk_drop")
    cut = F.coalesce(F.col("risk_threshold").cast("double"), F.lit(contract.DECISION_THRESHOLD))
    ids = [c for c in ("subscription_id", "cutoff_date") if c in predictions.columns]
    return (
        join_runs(predictions, runs, "left")
        .filter(p >= cut)
        .select(
            "customer_id",
            *ids,
            "churn_probability",
            "predicted_sales",
            (p * F.col("predicted_sales")).alias("expected_revenue_loss"),
            "prescriptive_action",
            "prescribed_risk_drop",
            (p - after).alias("expected_risk_reduction"),
            "run_id",
            "created_at",
        )
        .orderBy(F.col("expected_revenue_loss").desc())
    )


def create_views(predictions: DataFrame, telemetry: DataFrame) -> None:
    """Register the three views for SQL users of the session."""
    latest_predictions(predictions, telemetry).createOrReplaceTempView("latest_customer_predictions")
    drift_governance(telemetry).createOrReplaceTempView("model_drift_governance")
    retention_queue(predictions, telemetry).createOrReplaceTempView("high_risk_retention_queue")
