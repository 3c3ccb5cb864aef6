"""The subscription x cutoff spine: activity, targets, contract and account columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight import contract
from foresight.functions.dates import cutoffs_near, days, ntz, whole_days
from foresight.functions.flags import flag
from foresight.operators.skew import join_unique

Cutoffs = Sequence[datetime | str]


def live_at(cutoff: Column) -> Column:
    return (F.col("start_date") <= cutoff) & (
        F.col("end_date").isNull() | (F.col("end_date") > cutoff)
    )


def ever_live(subscriptions: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Subscriptions that can be active at some cutoff; both bounds reach the Parquet scan."""
    ordered = sorted(str(c) for c in cutoffs)
    if not ordered:
        return subscriptions.limit(0)
    return subscriptions.filter(
        (F.col("start_date") <= ntz(ordered[-1]))
        & (F.col("end_date").isNull() | (F.col("end_date") > ntz(ordered[0])))
    )


def explode_active(subscriptions: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """One row per subscription and cutoff at which it is active.

    The calendar is a literal array, so this is a narrow generate-and-filter: no join, no shuffle.
    """
    near = cutoffs_near(cutoffs, F.col("start_date"), F.col("end_date"))
    spine = subscriptions.withColumn("cutoff_date", F.explode(near))
    return spine.filter(live_at(F.col("cutoff_date")))


def active_subscriptions(subscriptions: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    return explode_active(ever_live(subscriptions, cutoffs), cutoffs)


def churn_target(horizon_days: int = contract.HORIZON_DAYS) -> Column:
    end, cutoff = F.col("end_date"), F.col("cutoff_date")
    return F.when((end > cutoff) & (end <= cutoff + days(horizon_days)), 1).otherwise(0)


def forward_mrr_target(horizon_days: int = contract.HORIZON_DAYS) -> Column:
    mrr = F.col("mrr_amount").cast("double")
    return F.when(churn_target(horizon_days) == 1, F.lit(0.0)).otherwise(mrr)


def with_targets(active: DataFrame, horizon_days: int = contract.HORIZON_DAYS) -> DataFrame:
    return active.withColumns(
        {
            contract.CHURN_TARGET: churn_target(horizon_days),
            contract.SALES_TARGET: forward_mrr_target(horizon_days),
        }
    )


def forward_mrr_from_churn(
    churn: str = contract.CHURN_TARGET, mrr: str = "mrr_amount"
) -> Column:
    """The forward revenue target rebuilt from the churn label when the column is missing."""
    return F.when(F.col(churn) == 1, F.lit(0.0)).otherwise(F.col(mrr).cast("double"))


def resolve_sales_target(df: DataFrame, revenue_col: str | None = None) -> tuple[DataFrame, str]:
    """The frame and the name of its revenue target: named column, stored target, rebuilt, MRR."""
    if revenue_col is not None:
        if revenue_col not in df.columns:
            raise KeyError(f"revenue column '{revenue_col}' is not in the data")
        return df, revenue_col
    if contract.SALES_TARGET in df.columns:
        return df, contract.SALES_TARGET
    if {"mrr_amount", contract.CHURN_TARGET} <= set(df.columns):
        return df.withColumn(contract.SALES_TARGET, forward_mrr_from_churn()), contract.SALES_TARGET
    if "mrr_amount" not in df.columns:
        raise KeyError("no revenue column in the data")
    return df, "mrr_amount"


def tenure_days() -> Column:
    return whole_days(F.col("start_date"), F.col("cutoff_date"))


def account_age_days() -> Column:
    signup = F.col("signup_date")
    return F.when(signup.isNotNull(), whole_days(signup, F.col("cutoff_date")))


def subscription_features(active: DataFrame) -> DataFrame:
    """Contract columns known at the cutoff; end date and outcome flags are not carried on."""
    return active.select(
        "subscription_id",
        "account_id",
        "cutoff_date",
        "plan_tier",
        "seats",
        "mrr_amount",
        "arr_amount",
        flag("is_trial").cast("int").alias("is_trial"),
        "billing_frequency",
        flag("auto_renew_flag").cast("int").alias("auto_renew_flag"),
        tenure_days().alias("active_tenure_days"),
    )


ACCOUNT_COLUMNS = ["account_id", "industry", "country", "referral_source", "signup_date"]


def attach_accounts(
    subscriptions: DataFrame, accounts: DataFrame, hot: Sequence | None = None
) -> DataFrame:
    """LEFT join of account columns at subscription grain, before cutoffs multiply the rows."""
    return join_unique(
        subscriptions, accounts, "account_id", "left", hot, spread=["subscription_id"]
    )


def account_features(
    subscriptions: DataFrame,
    accounts: DataFrame,
    cutoffs: Cutoffs,
    hot: Sequence | None = None,
) -> DataFrame:
    narrow = ever_live(subscriptions, cutoffs).select(
        "subscription_id", "account_id", "start_date", "end_date"
    )
    joined = attach_accounts(narrow, accounts.select(*ACCOUNT_COLUMNS), hot)
    return explode_active(joined, cutoffs).select(
        "subscription_id",
        "cutoff_date",
        "industry",
        "country",
        "referral_source",
        account_age_days().alias("account_age_days"),
    )
