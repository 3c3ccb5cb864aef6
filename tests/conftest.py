from __future__ import annotations

import random
import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from foresight import contract  # noqa: E402
from foresight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8)


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


CUTOFF = datetime(2024, 6, 30, 23, 59, 59)


@pytest.fixture(scope="session")
def raw(spark):
    """Two accounts, five subscriptions, five usage events and five tickets around one cutoff.

    Fixed values: the published test rows, whose expected features are known.
    """
    accounts = [
        ("A1", "Acme", "DevTools", "US", at("2024-01-01"), "organic", "Pro", 10, False, False),
        ("A2", "Beta", "FinTech", "UK", at("2024-04-01"), "ads", "Basic", 5, True, False),
    ]

    def sub(sid, account, start, end, tier, seats, mrr, trial, billing, renew):
        return (
            sid, account, at(start), at(end), tier, seats, mrr, 12 * mrr, trial, False, False, False,
            billing, renew,
        )

    subscriptions = [
        sub("S1", "A1", "2024-01-15", "2024-07-15", "Pro", 10, 500.0, False, "monthly", True),
        sub("S2", "A1", "2024-03-01", "2024-10-15", "Pro", 15, 750.0, False, "monthly", True),
        sub("S3", "A2", "2024-04-10", None, "Basic", 5, 100.0, True, "monthly", False),
        sub("S4", "A2", "2024-04-01", "2024-05-30", "Basic", 2, 50.0, False, "monthly", False),
        sub("S5", "A2", "2024-07-05", None, "Enterprise", 50, 2500.0, False, "annual", True),
    ]
    usage = [
        ("U1", "S1", at("2024-06-25"), "feature_1", 10, 600, 1, False),
        ("U2", "S1", at("2024-06-10"), "feature_2", 5, 300, 0, True),
        ("U3", "S1", at("2024-05-15"), "feature_3", 20, 1200, 0, False),
        ("U4", "S1", at("2024-07-05"), "feature_1", 100, 5000, 5, False),
        ("U5", "S1", at("2024-01-01"), "feature_1", 50, 2000, 0, False),
    ]
    tickets = [
        ("T1", "A1", at("2024-06-01T10:00:00"), at("2024-06-02T10:00:00"), 24.0, "urgent", 30, 4.0, True),
        ("T2", "A1", at("2024-06-30T22:00:00"), at("2024-07-02T12:00:00"), 96.0, "medium", 180, 5.0, False),
        ("T3", "A1", at("2024-04-01"), at("2024-04-02T10:00:00"), 24.0, "low", 120, 5.0, False),
        ("T4", "A1", at("2024-07-10"), at("2024-07-11T10:00:00"), 24.0, "urgent", 15, 1.0, True),
        ("T5", "A1", at("2023-12-01"), at("2023-12-02T10:00:00"), 24.0, "high", 45, 3.0, False),
    ]
    rows = {
        "accounts": accounts,
        "subscriptions": subscriptions,
        "feature_usage": usage,
        "support_tickets": tickets,
    }
    return {name: spark.createDataFrame(rows[name], contract.RAW_TABLES[name]) for name in rows}


CHOICES = {
    "industry": ["AUTOMOBILE", "BUILDING", "MACHINERY"],
    "country": ["BRAZIL", "CANADA", "JAPAN", "KENYA"],
    "referral_source": ["ads", "direct", "organic"],
    "plan_tier": ["Basic", "growth", "Pro"],
    "billing_frequency": ["monthly", "annual"],
}


def snapshot_rows(n: int = 120, seed: int = 42, months=("2024-05-31", "2024-06-30")) -> list[dict]:
    """Snapshot rows from two hidden traits: customer size scales the figures, engagement keeps customers.

    Every contract column is filled by its place in the contract: a trait times noise. Churn follows
    engagement, which the usage growth shows best; months take equal shares of the rows.
    """
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        size, engagement = draw.lognormvariate(3, 0.6), draw.random()
        row = {"subscription_id": f"s{i:05d}", "account_id": f"a{i // 3:05d}"}
        row["cutoff_date"] = months[i * len(months) // n]
        for place, column in enumerate(contract.NUMERIC):
            trait = size if place % 2 else 10 * engagement
            row[column] = round(trait * draw.uniform(0.5, 1.5), 3)
        row["usage_growth_14d_vs_prior14d"] = round(2 * engagement + draw.gauss(0, 0.15), 3)
        row |= {column: draw.choice(values) for column, values in CHOICES.items()}
        row |= {column: int(draw.random() < 0.4) for column in contract.BOOLEAN}
        churned = draw.random() < 0.9 * (1 - engagement) ** 2 + 0.02
        row[contract.CHURN_TARGET] = int(churned)
        row[contract.SALES_TARGET] = 0.0 if churned else row["mrr_amount"]
        rows.append(row)
    return rows


@pytest.fixture(scope="session")
def snapshot(spark):
    return spark.createDataFrame(snapshot_rows()).select(*contract.SNAPSHOT_COLUMNS).cache()
