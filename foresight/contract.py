"""Column lists, table schemas and thresholds shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: windows, thresholds and column names of the data contract ---
SNAPSHOT_START = "2023-03-31"
SNAPSHOT_END = "2024-11-30"
HORIZON_DAYS = 30
USAGE_WINDOW_DAYS = 30
USAGE_FLOOR_DAYS = 28
VELOCITY_DAYS = 14
SUPPORT_WINDOW_DAYS = 60
TEST_RATIO = 0.20
RISK_PERCENTILE = 0.90
DECISION_THRESHOLD = 0.50
TARGET_RISK_BOUND = 0.35
Z_95 = 1.96
PSI_BINS = 10
PSI_EPSILON = 1e-4
PSI_STABLE = 0.10
PSI_CRITICAL = 0.20
WRITE_BATCH = 500

IDENTIFIERS = ["subscription_id", "account_id", "cutoff_date"]
CHURN_TARGET = "churn_next_30d"
SALES_TARGET = "future_mrr_30d"

NUMERIC = [
    "account_age_days",
    "active_tenure_days",
    "seats",
    "mrr_amount",
    "arr_amount",
    "usage_count_30d",
    "usage_duration_secs_30d",
    "error_count_30d",
    "unique_features_30d",
    "beta_feature_ratio_30d",
    "usage_growth_14d_vs_prior14d",
    "ticket_count_60d",
    "urgent_ticket_count_60d",
    "escalation_count_60d",
    "avg_resolution_time_hours_60d",
    "avg_first_response_time_minutes_60d",
    "avg_satisfaction_score_60d",
    "satisfaction_response_count_60d",
]
CATEGORICAL = ["industry", "country", "referral_source", "plan_tier", "billing_frequency"]
BOOLEAN = ["is_trial", "auto_renew_flag"]
CONTRACT_REVENUE = ["mrr_amount", "arr_amount"]

PROHIBITED = [
    "end_date",
    "churn_flag",
    "churn_date",
    "reason_code",
    "refund_amount_usd",
    "preceding_upgrade_flag",
    "preceding_downgrade_flag",
    "is_reactivation",
    "feedback_text",
    "churn_event_id",
    "account_name",
    "upgrade_flag",
    "downgrade_flag",
]
MUTABLE = ["billing_frequency", "auto_renew_flag", "plan_tier", "is_trial"]
CALENDAR_AGING = ["account_age_days", "active_tenure_days"]

REQUIRED_TELEMETRY = [
    "model_version",
    "churn_auc",
    "sales_mape",
    "sales_rmse",
    "psi_score",
    "test_sample_count",
]
OPTIONAL_TELEMETRY = [
    "sales_mae",
    "sales_wmape",
    "risk_threshold",
    "risk_queue_count",
    "risk_queue_recall",
    "risk_queue_precision",
    "risk_queue_lift",
]
REQUIRED_PREDICTION = [
    "customer_id",
    "churn_probability",
    "predicted_sales",
    "sales_lower_bound",
    "sales_upper_bound",
    "prescriptive_action",
    "prescribed_risk_drop",
]
DEFAULT_NOTES = "Automated ingestion"
# --- End of fixed values ---

FEATURES = NUMERIC + CATEGORICAL + BOOLEAN
SALES_NUMERIC = [c for c in NUMERIC if c not in CONTRACT_REVENUE]
SALES_FEATURES = SALES_NUMERIC + CATEGORICAL + BOOLEAN
IMMUTABLE = [c for c in FEATURES if c not in MUTABLE]
SNAPSHOT_COLUMNS = IDENTIFIERS + FEATURES + [CHURN_TARGET, SALES_TARGET]

_TS = T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# --- Fixed values: table schemas ---
ACCOUNTS = _schema(
    ("account_id", T.StringType()),
    ("account_name", T.StringType()),
    ("industry", T.StringType()),
    ("country", T.StringType()),
    ("signup_date", _TS),
    ("referral_source", T.StringType()),
    ("plan_tier", T.StringType()),
    ("seats", T.IntegerType()),
    ("is_trial", T.BooleanType()),
    ("churn_flag", T.BooleanType()),
)
SUBSCRIPTIONS = _schema(
    ("subscription_id", T.StringType()),
    ("account_id", T.StringType()),
    ("start_date", _TS),
    ("end_date", _TS),
    ("plan_tier", T.StringType()),
    ("seats", T.IntegerType()),
    ("mrr_amount", T.DoubleType()),
    ("arr_amount", T.DoubleType()),
    ("is_trial", T.BooleanType()),
    ("upgrade_flag", T.BooleanType()),
    ("downgrade_flag", T.BooleanType()),
    ("churn_flag", T.BooleanType()),
    ("billing_frequency", T.StringType()),
    ("auto_renew_flag", T.BooleanType()),
)
FEATURE_USAGE = _schema(
    ("usage_id", T.StringType()),
    ("subscription_id", T.StringType()),
    ("usage_date", _TS),
    ("feature_name", T.StringType()),
    ("usage_count", T.LongType()),
    ("usage_duration_secs", T.LongType()),
    ("error_count", T.LongType()),
    ("is_beta_feature", T.BooleanType()),
)
SUPPORT_TICKETS = _schema(
    ("ticket_id", T.StringType()),
    ("account_id", T.StringType()),
    ("submitted_at", _TS),
    ("closed_at", _TS),
    ("resolution_time_hours", T.DoubleType()),
    ("priority", T.StringType()),
    ("first_response_time_minutes", T.LongType()),
    ("satisfaction_score", T.DoubleType()),
    ("escalation_flag", T.BooleanType()),
)
RAW_TABLES = {
    "accounts": ACCOUNTS,
    "subscriptions": SUBSCRIPTIONS,
    "feature_usage": FEATURE_USAGE,
    "support_tickets": SUPPORT_TICKETS,
}
FLAG_COLUMNS = {
    "accounts": [],
    "subscriptions": ["is_trial", "upgrade_flag", "downgrade_flag", "auto_renew_flag"],
    "feature_usage": ["is_beta_feature"],
    "support_tickets": ["escalation_flag"],
}

MODEL_TELEMETRY = _schema(
    ("run_id", T.StringType()),
    ("model_version", T.StringType()),
    ("churn_auc", T.DecimalType(5, 4)),
    ("sales_mape", T.DecimalType(5, 4)),
    ("sales_rmse", T.DecimalType(8, 2)),
    ("sales_mae", T.DecimalType(8, 2)),
    ("sales_wmape", T.DecimalType(5, 4)),
    ("psi_score", T.DecimalType(5, 4)),
    ("drift_flag", T.BooleanType()),
    ("test_sample_count", T.IntegerType()),
    ("risk_threshold", T.DecimalType(7, 6)),
    ("risk_queue_count", T.IntegerType()),
    ("risk_queue_recall", T.DecimalType(5, 4)),
    ("risk_queue_precision", T.DecimalType(5, 4)),
    ("risk_queue_lift", T.DecimalType(6, 2)),
    ("notes", T.StringType()),
    ("created_at", T.TimestampType()),
)
CUSTOMER_PREDICTIONS = _schema(
    ("run_id", T.StringType()),
    ("customer_id", T.StringType()),
    ("actual_churn", T.IntegerType()),
    ("churn_probability", T.DecimalType(5, 4)),
    ("actual_sales", T.DecimalType(8, 2)),
    ("predicted_sales", T.DecimalType(8, 2)),
    ("sales_lower_bound", T.DecimalType(8, 2)),
    ("sales_upper_bound", T.DecimalType(8, 2)),
    ("prescriptive_action", T.StringType()),
    ("prescribed_risk_drop", T.DecimalType(5, 4)),
    ("created_at", T.TimestampType()),
)
# --- End of fixed values ---
