"""Trailing product-usage figures per subscription and cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight import contract
from foresight.functions.dates import cutoffs_near, days, ntz
from foresight.functions.flags import flag, ratio
from foresight.operators.packing import at_cutoff, pack_by_cutoff
from foresight.operators.skew import join_unique
from foresight.operators.spine import Cutoffs, ever_live, explode_active, live_at

EVENT_COLUMNS = [
    "subscription_id",
    "usage_date",
    "feature_name",
    "usage_count",
    "usage_duration_secs",
    "error_count",
    "is_beta_feature",
]


def usage_candidates(
    usage: DataFrame,
    cutoffs: Cutoffs,
    window_days: int = contract.USAGE_WINDOW_DAYS,
    floor_days: int | None = contract.USAGE_FLOOR_DAYS,
) -> DataFrame:
    """Every event repeated for each cutoff whose candidate window holds it (closed at both ends)."""
    reach = _reach(window_days, floor_days)
    day, cutoff = F.col("usage_date"), F.col("cutoff_date")
    return (
        _in_calendar(usage, cutoffs, reach)
        .withColumn("cutoff_date", F.explode(cutoffs_near(cutoffs, day, day + days(reach))))
        .filter((day <= cutoff) & (day >= cutoff - days(reach)))
    )


def _reach(window_days: int, floor_days: int | None) -> int:
    """Days from the oldest candidate event to the cutoff; ``floor_days`` may be 0."""
    return max(window_days, 2 * contract.VELOCITY_DAYS) if floor_days is None else floor_days


def _in_calendar(usage: DataFrame, cutoffs: Cutoffs, reach: int) -> DataFrame:
    ordered = sorted(str(c) for c in cutoffs)
    if not ordered:
        return usage.limit(0)
    return usage.filter(
        (F.col("usage_date") >= ntz(ordered[0]) - days(reach))
        & (F.col("usage_date") <= ntz(ordered[-1]))
    )


def guarded_usage(
    usage: DataFrame,
    subscriptions: DataFrame,
    cutoffs: Cutoffs,
    window_days: int = contract.USAGE_WINDOW_DAYS,
    floor_days: int | None = contract.USAGE_FLOOR_DAYS,
    hot: Sequence | None = None,
) -> DataFrame:
    """Candidate events of subscriptions active at the cutoff, not older than the start date.

    The join runs once per event on ``subscription_id``; cutoffs are fanned out after it.
    """
    reach = _reach(window_days, floor_days)
    events = _in_calendar(usage.select(*EVENT_COLUMNS), cutoffs, reach)
    life = ever_live(subscriptions, cutoffs).select("subscription_id", "start_date", "end_date")
    joined = join_unique(events, life, "subscription_id", "inner", hot).filter(
        F.col("usage_date") >= F.col("start_date")
    )
    return usage_candidates(joined, cutoffs, window_days, floor_days).filter(
        live_at(F.col("cutoff_date"))
    )


def usage_aggregates(
    usage: DataFrame,
    subscriptions: DataFrame,
    cutoffs: Cutoffs,
    window_days: int = contract.USAGE_WINDOW_DAYS,
    floor_days: int | None = contract.USAGE_FLOOR_DAYS,
    hot: Sequence | None = None,
) -> DataFrame:
    """All usage sums in one aggregation, for (subscription, cutoff) pairs with any candidate event."""
    day, cutoff, count = F.col("usage_date"), F.col("cutoff_date"), F.col("usage_count")
    in_window = day >= cutoff - days(window_days)
    middle = cutoff - days(contract.VELOCITY_DAYS)
    oldest = cutoff - days(2 * contract.VELOCITY_DAYS)

    def total(condition: Column, column: Column) -> Column:
        return F.sum(F.when(condition, column))

    return (
        guarded_usage(usage, subscriptions, cutoffs, window_days, floor_days, hot)
        .groupBy("subscription_id", "cutoff_date")
        .agg(
            total(in_window, count).alias("usage_count"),
            total(in_window, F.col("usage_duration_secs")).alias("duration_secs"),
            total(in_window, F.col("error_count")).alias("errors"),
            F.count_distinct(F.when(in_window, F.col("feature_name"))).alias("features"),
            total(in_window & flag("is_beta_feature"), count).alias("beta_count"),
            total(day > middle, count).alias("recent"),
            total((day > oldest) & (day <= middle), count).alias("prior"),
        )
    )


def usage_feature_columns(name: str = "usage_by_cutoff") -> dict[str, Column]:
    """The six usage features of a row that carries the packed usage map."""
    count, recent, prior = (at_cutoff(name, f) for f in ("usage_count", "recent", "prior"))
    beta = ratio(at_cutoff(name, "beta_count"), count)
    return {
        "usage_count_30d": count,
        "usage_duration_secs_30d": at_cutoff(name, "duration_secs"),
        "error_count_30d": at_cutoff(name, "errors"),
        "unique_features_30d": at_cutoff(name, "features"),
        "beta_feature_ratio_30d": F.when(count > 0, beta).otherwise(0.0),
        "usage_growth_14d_vs_prior14d": (recent - prior) / (prior + 1.0),
    }


def usage_features(
    usage: DataFrame,
    subscriptions: DataFrame,
    cutoffs: Cutoffs,
    window_days: int = contract.USAGE_WINDOW_DAYS,
    floor_days: int | None = contract.USAGE_FLOOR_DAYS,
    hot: Sequence | None = None,
) -> DataFrame:
    """Usage features of every active (subscription, cutoff), zero without activity."""
    figures = usage_aggregates(usage, subscriptions, cutoffs, window_days, floor_days, hot)
    packed = pack_by_cutoff(figures, "subscription_id", "usage_by_cutoff")
    life = ever_live(subscriptions, cutoffs).select("subscription_id", "start_date", "end_date")
    features = [c.alias(n) for n, c in usage_feature_columns().items()]
    return explode_active(life.join(packed, "subscription_id", "left"), cutoffs).select(
        "subscription_id", "cutoff_date", *features
    )
