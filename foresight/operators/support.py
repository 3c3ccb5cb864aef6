"""Trailing support-ticket figures per account and cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight import contract
from foresight.functions.dates import cutoffs_near, days, ntz
from foresight.functions.flags import flag
from foresight.operators.packing import at_cutoff, pack_by_cutoff
from foresight.operators.skew import join_unique
from foresight.operators.spine import Cutoffs, ever_live, explode_active

# Priorities that count as urgent.
URGENT = ["urgent", "high"]

TICKET_COLUMNS = [
    "ticket_id",
    "account_id",
    "submitted_at",
    "closed_at",
    "resolution_time_hours",
    "priority",
    "first_response_time_minutes",
    "satisfaction_score",
    "escalation_flag",
]


def tickets_in_window(
    tickets: DataFrame, cutoffs: Cutoffs, window_days: int = contract.SUPPORT_WINDOW_DAYS
) -> DataFrame:
    """Every ticket repeated for each cutoff whose window holds it (closed at both ends)."""
    at, cutoff = F.col("submitted_at"), F.col("cutoff_date")
    return (
        _in_calendar(tickets, cutoffs, window_days)
        .withColumn("cutoff_date", F.explode(cutoffs_near(cutoffs, at, at + days(window_days))))
        .filter((at <= cutoff) & (at >= cutoff - days(window_days)))
    )


def _in_calendar(tickets: DataFrame, cutoffs: Cutoffs, window_days: int) -> DataFrame:
    ordered = sorted(str(c) for c in cutoffs)
    if not ordered:
        return tickets.limit(0)
    return tickets.filter(
        (F.col("submitted_at") >= ntz(ordered[0]) - days(window_days))
        & (F.col("submitted_at") <= ntz(ordered[-1]))
    )


def guarded_tickets(
    tickets: DataFrame,
    accounts: DataFrame,
    cutoffs: Cutoffs,
    window_days: int = contract.SUPPORT_WINDOW_DAYS,
    hot: Sequence | None = None,
) -> DataFrame:
    """Tickets of known accounts, submitted at or after signup, fanned out to their cutoffs."""
    columns = [c for c in TICKET_COLUMNS if c in tickets.columns]
    narrow = _in_calendar(tickets.select(*columns), cutoffs, window_days)
    signups = accounts.select("account_id", "signup_date").filter("signup_date IS NOT NULL")
    joined = join_unique(narrow, signups, "account_id", "inner", hot, spread=["ticket_id"]).filter(
        F.col("submitted_at") >= F.col("signup_date")
    )
    return tickets_in_window(joined, cutoffs, window_days)


def is_urgent() -> Column:
    return F.coalesce(F.lower("priority").isin(URGENT), F.lit(False))


def known_at_cutoff(column: str) -> Column:
    """An outcome recorded at closing time: null until the ticket is closed."""
    return F.when(F.col("closed_at") <= F.col("cutoff_date"), F.col(column))


def response_known_at_cutoff() -> Column:
    minutes = F.col("first_response_time_minutes")
    answered = F.col("submitted_at") + F.make_dt_interval(mins=minutes.cast("int"))
    return F.when(answered <= F.col("cutoff_date"), minutes)


def ticket_aggregates(
    tickets: DataFrame,
    accounts: DataFrame,
    cutoffs: Cutoffs,
    window_days: int = contract.SUPPORT_WINDOW_DAYS,
    hot: Sequence | None = None,
) -> DataFrame:
    satisfaction = known_at_cutoff("satisfaction_score")
    return (
        guarded_tickets(tickets, accounts, cutoffs, window_days, hot)
        .groupBy("account_id", "cutoff_date")
        .agg(
            F.count("ticket_id").alias("tickets"),
            F.sum(is_urgent().cast("int")).alias("urgent"),
            F.sum(flag("escalation_flag").cast("int")).alias("escalated"),
            F.avg(known_at_cutoff("resolution_time_hours")).alias("resolution_hours"),
            F.avg(response_known_at_cutoff()).alias("response_minutes"),
            F.avg(satisfaction).alias("satisfaction"),
            F.count(satisfaction).alias("satisfaction_responses"),
        )
    )


def support_feature_columns(name: str = "tickets_by_cutoff") -> dict[str, Column]:
    """The seven ticket features of a row that carries its account's packed ticket map."""
    return {
        "ticket_count_60d": at_cutoff(name, "tickets"),
        "urgent_ticket_count_60d": at_cutoff(name, "urgent"),
        "escalation_count_60d": at_cutoff(name, "escalated"),
        "avg_resolution_time_hours_60d": at_cutoff(name, "resolution_hours"),
        "avg_first_response_time_minutes_60d": at_cutoff(name, "response_minutes"),
        "avg_satisfaction_score_60d": at_cutoff(name, "satisfaction"),
        "satisfaction_response_count_60d": at_cutoff(name, "satisfaction_responses"),
    }


def support_features(
    subscriptions: DataFrame,
    accounts: DataFrame,
    tickets: DataFrame,
    cutoffs: Cutoffs,
    window_days: int = contract.SUPPORT_WINDOW_DAYS,
    hot_tickets: Sequence | None = None,
    hot_accounts: Sequence | None = None,
) -> DataFrame:
    """Ticket features of every active (subscription, cutoff): its account's figures, else zero."""
    figures = ticket_aggregates(tickets, accounts, cutoffs, window_days, hot_tickets)
    packed = pack_by_cutoff(figures, "account_id", "tickets_by_cutoff")
    life = ever_live(subscriptions, cutoffs).select(
        "subscription_id", "account_id", "start_date", "end_date"
    )
    joined = join_unique(
        life, packed, "account_id", "left", hot_accounts, spread=["subscription_id"]
    )
    features = [c.alias(n) for n, c in support_feature_columns().items()]
    return explode_active(joined, cutoffs).select("subscription_id", "cutoff_date", *features)
