"""Write-side validation: required columns, sanitising, rule checks, referential checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foresight import contract
from foresight.functions.numbers import round_half_even
from foresight.operators.skew import join_runs, join_unique

Rules = list[tuple[str, Column]]


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def prepare_telemetry(df: DataFrame) -> DataFrame:
    """Fill ``run_id``, ``drift_flag``, notes and time; round the metrics; keep optional columns."""
    require_columns(df, contract.REQUIRED_TELEMETRY, "telemetry")

    def given(name: str, fallback: Column) -> Column:
        return F.coalesce(F.col(name), fallback) if name in df.columns else fallback

    psi = F.col("psi_score").cast("double")
    filled = {
        "run_id": given("run_id", F.uuid()).cast("string"),
        "model_version": F.col("model_version").cast("string"),
        "churn_auc": round_half_even(F.col("churn_auc"), 4),
        "sales_mape": round_half_even(F.col("sales_mape"), 4),
        "sales_rmse": round_half_even(F.col("sales_rmse"), 2),
        "psi_score": round_half_even(psi, 4),
        "drift_flag": given("drift_flag", psi > contract.PSI_CRITICAL).cast("boolean"),
        "test_sample_count": F.col("test_sample_count").cast("int"),
        "notes": given("notes", F.lit(contract.DEFAULT_NOTES)).cast("string"),
        "created_at": given("created_at", F.current_timestamp()).cast("timestamp"),
    }
    types = {f.name: f.dataType for f in contract.MODEL_TELEMETRY}
    for name in contract.OPTIONAL_TELEMETRY:
        source = F.col(name) if name in df.columns else F.lit(None)
        numeric = T.DoubleType() if isinstance(types[name], T.DecimalType) else types[name]
        filled[name] = source.cast(numeric)
    return df.select(*[filled[f.name].alias(f.name) for f in contract.MODEL_TELEMETRY])


def prepare_predictions(df: DataFrame, run_id: str | Column) -> DataFrame:
    """Add the run and missing optional columns, round, and turn NaN into NULL."""
    require_columns(df, contract.REQUIRED_PREDICTION, "predictions")

    def number(name: str, digits: int) -> Column:
        value = F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
        return round_half_even(F.nanvl(value, F.lit(None).cast("double")), digits).alias(name)

    churn = F.col("actual_churn") if "actual_churn" in df.columns else F.lit(None)
    extra = [c for c in ("subscription_id", "cutoff_date", "created_at") if c in df.columns]
    return df.select(
        (F.lit(run_id) if isinstance(run_id, str) else run_id).cast("string").alias("run_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        churn.cast("int").alias("actual_churn"),
        number("churn_probability", 4),
        number("actual_sales", 2),
        number("predicted_sales", 2),
        number("sales_lower_bound", 2),
        number("sales_upper_bound", 2),
        F.col("prescriptive_action").cast("string").alias("prescriptive_action"),
        number("prescribed_risk_drop", 4),
        *extra,
    )


def _not_null(*names: str) -> Rules:
    return [(f"{n} is null", F.col(n).isNull()) for n in names]


def _outside(name: str, low: float | None, high: float | None = None) -> tuple[str, Column]:
    tests = []
    if low is not None:
        tests.append(F.col(name) < low)
    if high is not None:
        tests.append(F.col(name) > high)
    return f"{name} out of range", reduce(lambda a, b: a | b, tests)


def _overflow(schema: T.StructType) -> Rules:
    """A value with too many digits for the stored decimal type."""
    return [
        (
            f"{f.name} overflows {f.dataType.simpleString()}",
            F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(),
        )
        for f in schema
        if isinstance(f.dataType, T.DecimalType)
    ]


def telemetry_rules() -> Rules:
    """Violated when true; a null satisfies a range rule, as in a SQL CHECK."""
    return [
        *_not_null(*contract.REQUIRED_TELEMETRY, "drift_flag", "created_at"),
        _outside("churn_auc", 0, 1),
        _outside("sales_mape", 0),
        _outside("sales_rmse", 0),
        _outside("sales_mae", 0),
        _outside("sales_wmape", 0),
        _outside("psi_score", 0),
        ("test_sample_count out of range", F.col("test_sample_count") <= 0),
        *_overflow(contract.MODEL_TELEMETRY),
    ]


def prediction_rules() -> Rules:
    return [
        *_not_null("run_id", *contract.REQUIRED_PREDICTION),
        ("actual_churn out of range", ~F.col("actual_churn").isin(0, 1)),
        _outside("churn_probability", 0, 1),
        _outside("actual_sales", 0),
        _outside("predicted_sales", 0),
        _outside("prescribed_risk_drop", 0, 1),
        ("interval inverted", F.col("sales_upper_bound") < F.col("sales_lower_bound")),
        *_overflow(contract.CUSTOMER_PREDICTIONS),
    ]


def broken_rules(rules: Rules) -> Column:
    """Array of the names of the rules a row breaks."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))


def violations(df: DataFrame, rules: Rules, keys: Sequence[str]) -> DataFrame:
    """``(keys, rule)``, one row per broken rule."""
    return df.select(*keys, F.explode(broken_rules(rules)).alias("rule"))


def quarantine(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the rest with their ``rules``."""
    checked = df.withColumn("rules", broken_rules(rules))
    good = checked.filter(F.size("rules") == 0).drop("rules")
    return good, checked.filter(F.size("rules") > 0)


def orphans(predictions: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Predictions whose run is not registered."""
    return join_runs(predictions, telemetry.select("run_id"), "left_anti")


def without_runs(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows left after the runs in ``removed`` (``run_id``) are deleted, cascading to predictions."""
    return join_runs(df, removed.select("run_id"), "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that break the one-row-per-key contract of accounts and subscriptions."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def require_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """A repeated key would multiply the rows of every join to ``df``."""
    repeated = duplicate_keys(df, key).take(1)
    if repeated:
        raise ValueError(f"{what} repeats {key} {repeated[0][0]}")
    return df


def unknown_accounts(subscriptions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Subscriptions without an account row; the revenue model cannot score them."""
    known = accounts.select("account_id").withColumn("_known", F.lit(True))
    marked = join_unique(subscriptions, known, "account_id", "left")
    return marked.filter(F.col("_known").isNull()).drop("_known")


def integrity_summary(predictions: DataFrame) -> DataFrame:
    """One row: nulls in all columns together, and inverted intervals."""
    nulls = sum((F.col(c).isNull().cast("bigint") for c in predictions.columns), F.lit(0))
    inverted = F.col("sales_lower_bound") > F.col("sales_upper_bound")
    return predictions.agg(
        F.coalesce(F.sum(nulls), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum(inverted.cast("bigint")), F.lit(0)).alias("interval_violations"),
    )


def high_risk_sample(
    predictions: DataFrame, order_cols: Sequence[str], rows: int, cut: float = 0.65
) -> DataFrame:
    """The first ``rows`` rows above the cut in ``order_cols`` order: the report's short sample."""
    return (
        predictions.filter(F.col("churn_probability") > cut)
        .orderBy(*order_cols)
        .limit(rows)
        .select(
            "customer_id",
            "churn_probability",
            "predicted_sales",
            "prescriptive_action",
            "prescribed_risk_drop",
            *[c for c in order_cols if c not in contract.REQUIRED_PREDICTION],
        )
    )
