"""The snapshot job: four raw tables to one row per active subscription and cutoff."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight import contract
from foresight.functions.dates import month_ends
from foresight.functions.flags import flag
from foresight.operators.leakage import audit_leakage
from foresight.operators.packing import pack_by_cutoff
from foresight.operators.skew import hot_keys, join_unique
from foresight.operators.spine import (
    ACCOUNT_COLUMNS,
    account_age_days,
    churn_target,
    ever_live,
    explode_active,
    forward_mrr_target,
    tenure_days,
)
from foresight.operators.support import support_feature_columns, ticket_aggregates
from foresight.operators.usage import usage_aggregates, usage_feature_columns

CONTRACT_COLUMNS = [
    "subscription_id",
    "account_id",
    "start_date",
    "end_date",
    "plan_tier",
    "seats",
    "mrr_amount",
    "arr_amount",
    "is_trial",
    "billing_frequency",
    "auto_renew_flag",
]


def build_snapshots(
    accounts: DataFrame,
    subscriptions: DataFrame,
    usage: DataFrame,
    tickets: DataFrame,
    cutoffs: Sequence[datetime | str] | None = None,
    window_days: int = contract.USAGE_WINDOW_DAYS,
    floor_days: int | None = contract.USAGE_FLOOR_DAYS,
    support_days: int = contract.SUPPORT_WINDOW_DAYS,
    horizon_days: int = contract.HORIZON_DAYS,
    hot: dict[str, Sequence] | None = None,
) -> DataFrame:
    """All cutoffs in one plan; ``cutoff_date`` is a DATE in the result.

    Every join runs at entity grain: usage and ticket figures arrive as per-cutoff maps, and the
    spine is exploded last, in the same stage as the projection. ``hot`` may name the skewed keys
    (``usage``, ``tickets``, ``subscriptions``); missing entries are sampled.
    """
    cutoffs = month_ends() if cutoffs is None else list(cutoffs)
    hot = hot or {}
    contracts = ever_live(subscriptions, cutoffs).select(*CONTRACT_COLUMNS)
    usage_map = pack_by_cutoff(
        usage_aggregates(
            usage, subscriptions, cutoffs, window_days, floor_days, hot.get("usage")
        ),
        "subscription_id",
        "usage_by_cutoff",
    )
    ticket_map = pack_by_cutoff(
        ticket_aggregates(tickets, accounts, cutoffs, support_days, hot.get("tickets")),
        "account_id",
        "tickets_by_cutoff",
    )
    customers = accounts.select(*ACCOUNT_COLUMNS).join(ticket_map, "account_id", "left")
    hot_accounts = hot.get("subscriptions")
    if hot_accounts is None:
        hot_accounts = hot_keys(contracts, "account_id")
    entities = join_unique(
        contracts.join(usage_map, "subscription_id", "left"),
        customers,
        "account_id",
        "left",
        hot_accounts,
        spread=["subscription_id"],
    )
    derived = {
        "is_trial": flag("is_trial").cast("int"),
        "auto_renew_flag": flag("auto_renew_flag").cast("int"),
        "active_tenure_days": tenure_days(),
        "account_age_days": account_age_days(),
        "cutoff_date": F.col("cutoff_date").cast("date"),
        contract.CHURN_TARGET: churn_target(horizon_days),
        contract.SALES_TARGET: forward_mrr_target(horizon_days),
        **usage_feature_columns(),
        **support_feature_columns(),
    }
    spine = explode_active(entities, cutoffs)
    return spine.select(
        *[derived.get(c, F.col(c)).alias(c) for c in contract.SNAPSHOT_COLUMNS]
    )


def append_cohorts(*snapshots: DataFrame) -> DataFrame:
    """UNION ALL of snapshot tables built for different cutoffs."""
    first, *rest = snapshots
    for other in rest:
        first = first.unionByName(other)
    return first


def run_snapshot_job(
    spark: SparkSession,
    raw_dir: str,
    out_path: str,
    cutoffs: Sequence[datetime | str] | None = None,
    raw_format: str = "csv",
    hot: dict[str, Sequence] | None = None,
    compact: bool = True,
) -> DataFrame:
    """Load, check keys, build, audit, save; returns the saved table.

    ``hot`` is handed to ``build_snapshots``, ``compact`` to ``write_snapshots``.
    """
    from foresight.operators.quality import require_unique
    from foresight.sources.raw import load_raw
    from foresight.sources.store import read_snapshots, write_snapshots

    raw = load_raw(spark, raw_dir, raw_format)
    require_unique(raw["accounts"], "account_id", "accounts")
    require_unique(raw["subscriptions"], "subscription_id", "subscriptions")
    snapshots = build_snapshots(
        raw["accounts"],
        raw["subscriptions"],
        raw["feature_usage"],
        raw["support_tickets"],
        cutoffs,
        hot=hot,
    )
    write_snapshots(audit_leakage(snapshots), out_path, compact=compact)
    return read_snapshots(spark, out_path)
