"""The driver's star schema read as the four domain tables and a scored serving layer.

``checks.sql`` states the same mapping for DuckDB; the two are kept side by side on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight.functions.dates import month_ends

START, END = "1998-01-31", "1999-09-30"
CUTOFFS = month_ends(START, END)
# Every month end that the orders span.
WHOLE_SPAN = ("1995-01-31", "2001-08-31")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    first_order = (
        table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    )
    referral = F.expr(
        "CASE c_custkey % 4 WHEN 0 THEN 'organic' WHEN 1 THEN 'partner' WHEN 2 THEN 'ads' ELSE 'direct' END"
    )
    signup = F.col("first") + F.expr("make_dt_interval(cast(c_custkey % 700 as int), cast(c_custkey % 24 as int))")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(first_order, customer.c_custkey == first_order.o_custkey, "left")
        .select(
            F.col("c_custkey").alias("account_id"),
            F.col("c_name").alias("account_name"),
            F.col("c_mktsegment").alias("industry"),
            F.col("n_name").alias("country"),
            signup.alias("signup_date"),
            referral.alias("referral_source"),
        )
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.expr(
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Enterprise' WHEN '2-HIGH' THEN 'professional' "
        "WHEN '3-MEDIUM' THEN 'starter' WHEN '4-NOT SPECIFIED' THEN 'Basic' ELSE 'growth' END"
    )
    end = F.expr(
        "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + make_dt_interval(cast(30 + o_orderkey % 360 as int)) END"
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("subscription_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").alias("start_date"),
        end.alias("end_date"),
        tier.alias("plan_tier"),
        F.expr("cast(1 + o_orderkey % 50 as int)").alias("seats"),
        F.expr("o_totalprice / 100.0D").alias("mrr_amount"),
        F.expr("o_totalprice / 100.0D * 12.0D").alias("arr_amount"),
        F.expr("o_orderstatus = 'P'").alias("is_trial"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'annual' ELSE 'monthly' END").alias("billing_frequency"),
        F.expr("CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_orderkey % 2 = 0 END").alias("auto_renew_flag"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("subscription_id"),
        F.col("l_shipdate").alias("usage_date"),
        F.expr("concat('f', cast(l_partkey % 20 as string))").alias("feature_name"),
        F.expr("cast(l_quantity as bigint)").alias("usage_count"),
        F.expr("cast(floor(l_extendedprice) as bigint)").alias("usage_duration_secs"),
        F.expr("cast(l_linenumber % 3 as bigint)").alias("error_count"),
        F.expr("l_discount > 0.05D").alias("is_beta_feature"),
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "(ts - make_dt_interval(cast(8888 + 30 * (event_id % 24) as int)))"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ticket_id"),
        F.col("user_id").alias("account_id"),
        F.expr(at).alias("submitted_at"),
        F.expr(
            f"CASE WHEN event_id % 10 <> 0 THEN {at} + make_dt_interval(0, 0, 0, floor(value * 3600)) END"
        ).alias("closed_at"),
        F.expr("floor(value * 4) / 4.0D").alias("resolution_time_hours"),
        F.expr(
            "CASE event_type WHEN 'error' THEN 'URGENT' WHEN 'purchase' THEN 'High' "
            "WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' END"
        ).alias("priority"),
        F.expr("CASE WHEN event_id % 7 <> 0 THEN event_id % 600 END").alias("first_response_time_minutes"),
        F.expr("CASE WHEN event_id % 3 <> 0 THEN cast(1 + event_id % 5 as double) END").alias("satisfaction_score"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 4 = 0 END").alias("escalation_flag"),
    )


def raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "accounts": accounts(spark, sf_dir),
        "subscriptions": subscriptions(spark, sf_dir),
        "feature_usage": usage(spark, sf_dir),
        "support_tickets": tickets(spark, sf_dir),
    }


# --- A scored population with closed-form scores, so that metrics have an exact twin ---

HOLDOUT_START = "1999-05-31"
PROBABILITY = "((subscription_id * 7919 + month(cutoff_date) * 613) % 10000) / 10000.0D"
FORECAST = "mrr_amount * ((60 + subscription_id % 81) / 100.0D) - 300.0D"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foresight.operators.spine import active_subscriptions, with_targets

    targets = with_targets(active_subscriptions(subscriptions(spark, sf_dir), CUTOFFS))
    return targets.select(
        "subscription_id",
        "account_id",
        F.col("cutoff_date").cast("date").alias("cutoff_date"),
        "mrr_amount",
        "churn_next_30d",
        "future_mrr_30d",
        F.expr(PROBABILITY).alias("churn_probability"),
        F.expr(FORECAST).alias("raw_forecast"),
        F.expr(f"greatest(0.0D, {FORECAST})").alias("predicted_sales"),
    )


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).filter(F.col("cutoff_date") >= F.lit(HOLDOUT_START).cast("date"))


# --- Serving tables: one run per holdout month ---


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = "(subscription_id * 7919 + month(cutoff_date) * 613) % 10000"
    cents = "floor(mrr_amount * (80 + subscription_id % 41))"
    after = (
        f"CASE subscription_id % 3 WHEN 0 THEN {basis} WHEN 1 THEN (({basis}) * 7) div 10"
        f" ELSE (({basis}) * 4) div 10 END"
    )
    forecast = F.expr(f"cast({cents} / 100.0D as decimal(8,2))")
    half = F.expr("cast(150.25 as decimal(8,2))")
    action = F.expr(
        "CASE subscription_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'annual plan' ELSE 'auto renew' END"
    )
    money = "decimal(8,2)"
    return holdout(spark, sf_dir).select(
        F.concat(F.lit("run-"), F.date_format("cutoff_date", "yyyy-MM")).alias("run_id"),
        F.col("account_id").cast("string").alias("customer_id"),
        "subscription_id",
        "cutoff_date",
        F.col("churn_next_30d").alias("actual_churn"),
        F.expr(f"cast(({basis}) / 10000.0D as decimal(5,4))").alias("churn_probability"),
        F.expr(f"cast(floor(future_mrr_30d * 100) / 100.0D as {money})").alias("actual_sales"),
        forecast.alias("predicted_sales"),
        F.greatest(F.lit(0), forecast - half).cast(money).alias("sales_lower_bound"),
        (forecast + half).cast(money).alias("sales_upper_bound"),
        action.alias("prescriptive_action"),
        F.expr(f"cast(({after}) / 10000.0D as decimal(5,4))").alias("prescribed_risk_drop"),
        F.col("cutoff_date").cast("timestamp_ntz").alias("created_at"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that depend on the month and the run's rows; July has no queue threshold."""
    per_run = (
        holdout(spark, sf_dir)
        .groupBy("cutoff_date")
        .agg(F.count("*").alias("n"), F.sum("churn_next_30d").alias("churners"))
        .withColumn("m", F.month("cutoff_date"))
    )
    e = F.expr
    return per_run.select(
        F.concat(F.lit("run-"), F.date_format("cutoff_date", "yyyy-MM")).alias("run_id"),
        F.concat(F.lit("v"), F.col("m")).alias("model_version"),
        e("cast(0.70D + (n % 97) / 1000.0D as decimal(5,4))").alias("churn_auc"),
        e("cast(0.05D + (churners % 50) / 1000.0D as decimal(5,4))").alias("sales_mape"),
        e("cast(10 + (n % 1000) / 10.0D as decimal(8,2))").alias("sales_rmse"),
        e("CASE WHEN m <> 6 THEN cast(5 + (n % 1000) / 20.0D as decimal(8,2)) END").alias("sales_mae"),
        e("cast(0.04D + m / 1000.0D as decimal(5,4))").alias("sales_wmape"),
        e("cast((m - 4) * 6 / 100.0D as decimal(5,4))").alias("psi_score"),
        e("(m - 4) * 6 > 20").alias("drift_flag"),
        e("cast(n as int)").alias("test_sample_count"),
        e("CASE WHEN m <> 7 THEN cast((80 + m) / 100.0D as decimal(7,6)) END").alias("risk_threshold"),
        e("cast(n div 10 as int)").alias("risk_queue_count"),
        e("cast(0.5D as decimal(5,4))").alias("risk_queue_recall"),
        e("cast(0.25D as decimal(5,4))").alias("risk_queue_precision"),
        e("cast(m / 4.0D as decimal(6,2))").alias("risk_queue_lift"),
        F.concat(F.lit("month "), F.col("m")).alias("notes"),
        (F.col("cutoff_date").cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
    )


def dirty_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serving rows as doubles with broken values planted by subscription id."""

    def swap(name: str, condition: str, value: str, dtype: str = "double"):
        return F.expr(f"CASE WHEN {condition} THEN {value} ELSE cast({name} as {dtype}) END").alias(name)

    return predictions(spark, sf_dir).select(
        swap("run_id", "subscription_id % 59 = 0", "'run-missing'", "string"),
        "customer_id",
        "subscription_id",
        "cutoff_date",
        swap("actual_churn", "subscription_id % 71 = 0", "2", "int"),
        swap("churn_probability", "subscription_id % 50 = 0", "1.5D"),
        "actual_sales",
        swap("predicted_sales", "subscription_id % 67 = 0", "12345678.9D"),
        swap("sales_lower_bound", "subscription_id % 53 = 0", "sales_upper_bound + 1"),
        F.col("sales_upper_bound").cast("double").alias("sales_upper_bound"),
        swap("prescriptive_action", "subscription_id % 61 = 0", "NULL", "string"),
        swap("prescribed_risk_drop", "subscription_id % 73 = 0", "cast('NaN' as double)"),
    )
