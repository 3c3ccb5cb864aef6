"""Text labels and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foresight import contract
from foresight.functions.numbers import fixed

# --- Fixed values: label texts ---
RUN_STABLE = "Stable (No Shift)"
RUN_MODERATE = "Moderate Shift (Monitor)"
RUN_CRITICAL = "Critical Drift (Action Required)"
FEATURE_STABLE = "Stable"
FEATURE_MODERATE = "Moderate Shift"
FEATURE_CRITICAL = "Critical Drift"
FEATURE_AGING = "Expected Calendar Aging"
TIER_QUEUE = "Top-10% Operational Risk Queue"
TIER_1 = "Tier 1 - Critical Risk (>75%)"
TIER_2 = "Tier 2 - Elevated Risk (50-75%)"
TIER_3 = "Tier 3 - Moderate Risk (25-50%)"
TIER_4 = "Tier 4 - Stable (<25%)"
DRIFT_ALERT = "⚠️ CRITICAL DRIFT DETECTED"
DRIFT_OK = "✅ MODELS STABLE (Overall PSI < 0.20; Calendar Aging Documented)"
# --- End of fixed values ---


def run_drift_label(psi: Column) -> Column:
    return (
        F.when(psi < contract.PSI_STABLE, RUN_STABLE)
        .when(psi <= contract.PSI_CRITICAL, RUN_MODERATE)
        .otherwise(RUN_CRITICAL)
    )


def feature_drift_label(feature: Column, psi: Column) -> Column:
    aging = feature.isin(contract.CALENDAR_AGING) & (psi > contract.PSI_CRITICAL)
    return (
        F.when(aging, FEATURE_AGING)
        .when(psi < contract.PSI_STABLE, FEATURE_STABLE)
        .when(psi <= contract.PSI_CRITICAL, FEATURE_MODERATE)
        .otherwise(FEATURE_CRITICAL)
    )


def risk_tier(probability: Column, threshold: Column) -> Column:
    """Queue membership first, then the fixed probability tiers; a null threshold has no queue."""
    return (
        F.when(probability >= threshold, TIER_QUEUE)
        .when(probability >= 0.75, TIER_1)
        .when(probability >= 0.50, TIER_2)
        .when(probability >= 0.25, TIER_3)
        .otherwise(TIER_4)
    )


def percent(value: Column, digits: int) -> Column:
    return F.concat(fixed(value.cast("double") * 100, digits), F.lit("%"))


def dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value.cast("double"), 2))
