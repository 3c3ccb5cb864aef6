"""BI measures and dashboard queries over scored predictions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight import contract
from foresight.functions.flags import ratio
from foresight.functions.labels import DRIFT_ALERT, DRIFT_OK, dollars, percent
from foresight.operators.ranking import ntile, with_row_number
from foresight.operators.views import latest_run


def _money(condition: Column) -> Column:
    """Conditional sum of the stored decimals: exact, and zero rather than null when empty."""
    sales = F.col("predicted_sales").cast("decimal(18,2)")
    return F.coalesce(F.sum(F.when(condition, sales)), F.lit(0)).cast("double")


def total_expected_mrr(predictions: DataFrame) -> DataFrame:
    return predictions.agg(_money(F.lit(True)).alias("total_expected_mrr"))


def _with_highest_threshold(predictions: DataFrame, telemetry: DataFrame) -> DataFrame:
    highest = telemetry.agg(F.max("risk_threshold")).scalar()
    return predictions.withColumn("queue_threshold", highest)


def queue_measures(predictions: DataFrame, telemetry: DataFrame) -> DataFrame:
    """One row: revenue in the queue, recoverable revenue, and the share of rows queued."""
    queued = F.col("churn_probability") >= F.col("queue_threshold")
    lowered = F.col("prescribed_risk_drop") < F.col("churn_probability")
    rows = _with_highest_threshold(predictions, telemetry)
    return rows.agg(
        _money(queued).alias("revenue_in_queue"),
        _money(queued & lowered).alias("recoverable_revenue"),
        ratio(F.sum(F.when(queued, 1)), F.count("*")).alias("queue_selection_rate"),
    )


def drift_status_text(telemetry: DataFrame) -> DataFrame:
    """The alert only when the runs in scope agree on one true flag."""
    single = F.count_distinct("drift_flag") + F.max(F.col("drift_flag").isNull().cast("int")) == 1
    alert = F.coalesce(single & F.max("drift_flag"), F.lit(False))
    return telemetry.agg(F.when(alert, DRIFT_ALERT).otherwise(DRIFT_OK).alias("drift_status_text"))


def average_interval_spread(predictions: DataFrame) -> DataFrame:
    spread = (F.col("sales_upper_bound") - F.col("sales_lower_bound")).cast("decimal(18,2)")
    mean = F.try_divide(F.sum(spread).cast("double"), F.count(spread).cast("double"))
    return predictions.agg(mean.alias("avg_interval_spread"))


def exposure_at_cut(
    predictions: DataFrame,
    cut: float = contract.DECISION_THRESHOLD,
    recoverable_below: float = contract.TARGET_RISK_BOUND,
) -> DataFrame:
    """One row: sales, sales at risk, recoverable sales at a probability cut, and their shares."""
    risky = F.col("churn_probability") >= cut
    saved = F.col("prescribed_risk_drop") < recoverable_below
    sums = predictions.agg(
        _money(F.lit(True)).alias("total_sales"),
        _money(risky).alias("revenue_at_risk"),
        _money(risky & saved).alias("recoverable_revenue"),
        F.count("*").alias("customers"),
    )
    return sums.withColumns(
        {
            "at_risk_pct": ratio(F.col("revenue_at_risk") * 100, F.col("total_sales")),
            "recoverable_pct": ratio(F.col("recoverable_revenue") * 100, F.col("revenue_at_risk")),
        }
    )


def tier_list(latest: DataFrame) -> DataFrame:
    return latest.select("risk_tier").filter(F.col("risk_tier").isNotNull()).distinct()


def in_tiers(latest: DataFrame, tiers: Sequence[str]) -> DataFrame:
    return latest.filter(F.col("risk_tier").isin(list(tiers)))


def search_customers(latest: DataFrame, text: str, regex: bool = False) -> DataFrame:
    """Case-insensitive lookup in ``customer_id``; blank text keeps all rows."""
    text = text.strip()
    if not text:
        return latest
    if regex:
        return latest.filter(F.col("customer_id").rlike(f"(?i){text}"))
    return latest.filter(F.lower("customer_id").contains(text.lower()))


def systematic_sample(
    latest: DataFrame, order_cols: Sequence[str], target: int
) -> DataFrame:
    """Every ``max(1, n // min(target, n))``-th row by predicted sales, labelled ``Sub-1`` onwards.

    ``order_cols`` has to break ties among equal sales. Between ``target`` and ``2 * target - 1``
    rows come back once there are that many. Only the order columns are sorted; the sample's keys,
    fewer than ``2 * target``, are broadcast to fetch the other columns.
    """
    keys = list(dict.fromkeys(["predicted_sales", *order_cols]))
    ranked = with_row_number(latest.select(*keys), keys, "_position")
    n = ranked.count()
    step = max(1, n // max(1, min(target, n)))
    label = F.concat(F.lit("Sub-"), F.floor((F.col("_position") - 1) / step) + 1)
    picked = ranked.filter((F.col("_position") - 1) % step == 0).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], label.alias("subscriber_idx")
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return latest.join(F.broadcast(picked), same).select(*latest.columns, "subscriber_idx")


def priority_table(
    latest: DataFrame, cut: float = contract.DECISION_THRESHOLD, ties: Sequence[str] = ()
) -> DataFrame:
    """Rows at or above the cut, riskiest first, with display formats."""
    return (
        latest.filter(F.col("churn_probability") >= cut)
        .orderBy(F.col("churn_probability").desc(), *ties)
        .select(
            "customer_id",
            *[c for c in ties if c != "customer_id"],
            "risk_tier",
            percent(F.col("churn_probability"), 1).alias("churn_risk"),
            dollars(F.col("predicted_sales")).alias("monthly_spend"),
            "prescriptive_action",
            percent(F.col("prescribed_risk_drop"), 1).alias("post_intervention_risk"),
            "is_recoverable_revenue",
        )
    )


def spend_deciles(
    latest: DataFrame, order_cols: Sequence[str], buckets: int = 10
) -> DataFrame:
    """Mean lower bound, forecast and upper bound per spend decile; ``order_cols`` break ties."""
    keys = ["predicted_sales", *order_cols]
    needed = dict.fromkeys([*keys, "sales_lower_bound", "sales_upper_bound"])
    ranked = with_row_number(latest.select(*needed), keys, "_position")
    total = ranked.count()
    tile = ntile(F.col("_position"), F.lit(total), buckets)

    def mean(column: str) -> Column:
        exact = F.sum(F.col(column).cast("decimal(18,2)")).cast("double")
        return F.try_divide(exact, F.count(column).cast("double")).alias(column)

    return ranked.groupBy(tile.alias("decile")).agg(
        mean("sales_lower_bound"),
        mean("predicted_sales"),
        mean("sales_upper_bound"),
        F.count("*").alias("customers"),
    )


def scoring_summary(
    predictions: DataFrame,
    cut: float = contract.DECISION_THRESHOLD,
    recoverable_below: float = contract.TARGET_RISK_BOUND,
) -> DataFrame:
    """One row of headline figures for a scored table; shares in percent."""
    risky = F.col("churn_probability") >= cut
    saved = F.col("prescribed_risk_drop") < recoverable_below

    def mean(column: str) -> Column:
        exact = F.sum(F.col(column).cast("decimal(18,2)")).cast("double")
        return F.try_divide(exact, F.count(column).cast("double"))

    sums = predictions.agg(
        F.count("*").alias("customers"),
        F.coalesce(F.sum(risky.cast("bigint")), F.lit(0)).alias("high_risk_customers"),
        _money(F.lit(True)).alias("total_sales"),
        _money(risky).alias("revenue_at_risk"),
        _money(risky & saved).alias("recoverable_revenue"),
        (mean("sales_upper_bound") - mean("sales_lower_bound")).alias("avg_interval_band"),
    )
    return sums.withColumns(
        {
            "high_risk_pct": ratio(F.col("high_risk_customers") * 100, F.col("customers")),
            "at_risk_pct": ratio(F.col("revenue_at_risk") * 100, F.col("total_sales")),
            "recoverable_pct": ratio(F.col("recoverable_revenue") * 100, F.col("revenue_at_risk")),
        }
    )


def run_header(telemetry: DataFrame) -> DataFrame:
    """PSI, drift flag, AUC and MAPE of the newest run."""
    psi = F.col("psi_score").cast("double")
    return latest_run(telemetry).select(
        "model_version",
        "run_timestamp",
        psi.alias("psi_score"),
        F.coalesce("drift_flag", psi > contract.PSI_CRITICAL).alias("drift_flag"),
        F.col("churn_auc").cast("double").alias("churn_auc"),
        F.col("sales_mape").cast("double").alias("sales_mape"),
    )
