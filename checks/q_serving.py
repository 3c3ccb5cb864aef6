"""Stored tables: validation, upserts, views, BI measures and dashboard queries."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import testbed
from checks.q_features import scratch
from checks.registry import query
from checks.sql import ACTIVE, DIRTY, LATEST, RAW, SCORED, SERVING, with_
from foresight.operators import measures, quality, views
from foresight.operators.outputs import with_customer_id
from foresight.sources import store
from foresight.sources.commits import CommittedTable

BASE = with_(RAW, ACTIVE, SCORED, SERVING)
TOP = with_(RAW, ACTIVE, SCORED, SERVING, LATEST)
DIRT = with_(RAW, ACTIVE, SCORED, SERVING, DIRTY)

TIES = ["customer_id", "subscription_id"]


def _tables(spark, sf):
    return testbed.predictions(spark, sf), testbed.telemetry(spark, sf)


def _latest(spark, sf):
    return views.latest_predictions(*_tables(spark, sf))


# --- A: stored tables ---

DASHBOARD = (
    "SELECT run_id, model_version, customer_id, subscription_id, churn_probability::DOUBLE AS churn_probability,"
    " risk_tier, predicted_sales::DOUBLE AS predicted_sales, is_recoverable_revenue FROM latest"
)


@query("a6_dashboard_rows", TOP + DASHBOARD + "")
def a6(spark, sf):
    return views.dashboard_rows(*_tables(spark, sf), order_cols=TIES).select(
        "run_id",
        "model_version",
        "customer_id",
        "subscription_id",
        "churn_probability",
        "risk_tier",
        "predicted_sales",
        "is_recoverable_revenue",
    )


_EXPORT = (
    "SELECT customer_id, subscription_id, churn_probability::DOUBLE AS churn_probability,"
    " predicted_sales::DOUBLE AS predicted_sales FROM predictions"
)


@query("a8_exported_predictions", BASE + f"{_EXPORT} UNION ALL {_EXPORT}")
def a8(spark, sf):
    """Both CSV exports read back: the same rows twice."""
    predictions, telemetry = _tables(spark, sf)
    paths = store.write_outputs(predictions, telemetry, scratch(spark))
    exports = [
        spark.read.option("header", True).csv(paths[name]) for name in ("predictions", "holdout")
    ]
    return exports[0].unionByName(exports[1]).select(
        "customer_id",
        F.col("subscription_id").cast("bigint").alias("subscription_id"),
        F.col("churn_probability").cast("double").alias("churn_probability"),
        F.col("predicted_sales").cast("double").alias("predicted_sales"),
    )


@query("a8b_exported_telemetry", BASE + "SELECT run_id, notes, test_sample_count::BIGINT AS test_sample_count FROM telemetry")
def a8b(spark, sf):
    predictions, telemetry = _tables(spark, sf)
    paths = store.write_outputs(predictions, telemetry, scratch(spark))
    return spark.read.json(paths["telemetry"]).select("run_id", "notes", "test_sample_count")


UPSERT = (
    ", incoming AS (SELECT * REPLACE (0.9999 AS churn_auc, 'later' AS notes,"
    " CASE WHEN run_id = 'run-1999-09' THEN 'run-1999-10' ELSE run_id END AS run_id) FROM telemetry"
    " WHERE run_id >= 'run-1999-08') "
    "SELECT coalesce(o.run_id, n.run_id) AS run_id, coalesce(n.churn_auc, o.churn_auc)::DOUBLE AS churn_auc,"
    " coalesce(o.notes, n.notes) AS notes, coalesce(n.psi_score, o.psi_score)::DOUBLE AS psi_score,"
    " coalesce(o.test_sample_count, n.test_sample_count) AS test_sample_count"
    " FROM telemetry o FULL JOIN incoming n ON o.run_id = n.run_id"
)


def _second_write(telemetry):
    """August again with new figures, and September's row under a new run id."""
    moved = F.when(F.col("run_id") == "run-1999-09", "run-1999-10").otherwise(F.col("run_id"))
    return (
        telemetry.filter(F.col("run_id") >= "run-1999-08")
        .withColumn("churn_auc", F.lit("0.9999").cast("decimal(5,4)"))
        .withColumn("notes", F.lit("later"))
        .withColumn("run_id", moved)
    )


UPSERT_COLUMNS = ["run_id", "churn_auc", "notes", "psi_score", "test_sample_count"]


@query("a9_merged_telemetry", BASE.rstrip() + UPSERT)
def a9(spark, sf):
    telemetry = testbed.telemetry(spark, sf)
    return store.merge_telemetry(telemetry, _second_write(telemetry)).select(*UPSERT_COLUMNS)


@query("a9b_stored_telemetry_upsert", BASE.rstrip() + UPSERT)
def a9b(spark, sf):
    path, telemetry = scratch(spark), testbed.telemetry(spark, sf)
    store.log_telemetry(spark, telemetry, path)
    store.log_telemetry(spark, _second_write(telemetry), path)
    return spark.read.parquet(path).select(*UPSERT_COLUMNS)


@query(
    "a10_ingestion_summary",
    BASE + "SELECT run_id, count(*) AS total_records, ceil(count(*) / 500.0)::BIGINT AS batch_count"
    " FROM predictions GROUP BY 1",
)
def a10(spark, sf):
    return store.ingestion_summary(testbed.predictions(spark, sf))


STORED = (
    BASE + "SELECT run_id, customer_id, subscription_id, churn_probability::DOUBLE AS churn_probability,"
    " predicted_sales::DOUBLE AS predicted_sales FROM predictions"
)
STORED_COLUMNS = ["run_id", "customer_id", "subscription_id", "churn_probability", "predicted_sales"]


def _runs(predictions: DataFrame) -> list[str]:
    """The table's runs, one a month."""
    return [r[0] for r in predictions.select("run_id").distinct().orderBy("run_id").collect()]


@query("a10b_stored_predictions", STORED)
def a10b(spark, sf):
    path, predictions = scratch(spark), testbed.predictions(spark, sf)
    runs = _runs(predictions)
    for run in [*runs, *runs[-1:]]:  # a retry replaces the run
        rows = predictions.filter(F.col("run_id") == run).drop("run_id")
        store.log_predictions(spark, run, rows, path)
    return spark.read.parquet(path).select(*STORED_COLUMNS)


@query("a10c_committed_predictions", STORED)
def a10c(spark, sf):
    """Every run is staged and committed; the last one first fails half-way, then a stage is left without
    its commit, then it is retried twice. Readers see the committed rows alone."""
    table, predictions = CommittedTable(spark, scratch(spark)), testbed.predictions(spark, sf)
    runs = _runs(predictions)
    for run in runs:
        rows = predictions.filter(F.col("run_id") == run).drop("run_id")
        if run == runs[-1]:
            broken = F.when(F.col("subscription_id") % 50 == 0, 1.5).otherwise(F.col("churn_probability").cast("double"))
            with contextlib.suppress(ValueError):
                table.append(run, rows.withColumn("churn_probability", broken))
            table.stage(run, rows)
            table.append(run, rows, token="last")
        table.append(run, rows, token="last")
    return table.read().select(*STORED_COLUMNS)


# --- L: validation ---


@query(
    "l2_prepared_telemetry",
    BASE + "SELECT coalesce(run_id, '') AS run_id, model_version, round(churn_auc::DOUBLE, 4) AS churn_auc,"
    " round(psi_score::DOUBLE, 4) AS psi_score, psi_score::DOUBLE > 0.20 AS drift_flag, test_sample_count,"
    " 'Automated ingestion' AS notes, sales_mae::DOUBLE AS sales_mae, risk_queue_count FROM telemetry",
)
def l2(spark, sf):
    bare = testbed.telemetry(spark, sf).drop("drift_flag", "notes")
    return quality.prepare_telemetry(bare).select(
        "run_id",
        "model_version",
        "churn_auc",
        "psi_score",
        "drift_flag",
        "test_sample_count",
        "notes",
        "sales_mae",
        "risk_queue_count",
    )


@query(
    "l4_prepared_predictions",
    DIRT + "SELECT 'run-y' AS run_id, customer_id, subscription_id, NULL::DOUBLE AS actual_sales,"
    " churn_probability, predicted_sales, prescribed_risk_drop FROM dirty",
)
def l4(spark, sf):
    bare = testbed.dirty_predictions(spark, sf).drop("actual_sales", "run_id")
    return quality.prepare_predictions(bare, "run-y").select(
        "run_id",
        "customer_id",
        "subscription_id",
        "actual_sales",
        "churn_probability",
        "predicted_sales",
        "prescribed_risk_drop",
    )


def _prepared(spark, sf):
    return quality.prepare_predictions(testbed.dirty_predictions(spark, sf), F.col("run_id"))


VIOLATIONS = " UNION ALL ".join(
    f"SELECT subscription_id, cutoff_date::VARCHAR AS cutoff_date, '{rule}' AS rule FROM dirty WHERE {test}"
    for rule, test in [
        ("prescriptive_action is null", "prescriptive_action IS NULL"),
        ("prescribed_risk_drop is null", "prescribed_risk_drop IS NULL"),
        ("actual_churn out of range", "actual_churn NOT IN (0, 1)"),
        ("churn_probability out of range", "churn_probability > 1"),
        ("interval inverted", "sales_upper_bound < sales_lower_bound"),
        ("predicted_sales overflows decimal(8,2)", "predicted_sales >= 1000000"),
    ]
)


@query("l5_rule_violations", DIRT + VIOLATIONS)
def l5(spark, sf):
    return quality.violations(_prepared(spark, sf), quality.prediction_rules(), ["subscription_id", "cutoff_date"])


@query(
    "l5b_quarantined_rows",
    DIRT + "SELECT prescriptive_action IS NULL OR prescribed_risk_drop IS NULL OR actual_churn > 1 OR"
    " churn_probability > 1 OR sales_upper_bound < sales_lower_bound OR predicted_sales >= 1000000 AS quarantined,"
    " count(*) AS row_count FROM dirty GROUP BY 1",
)
def l5b(spark, sf):
    good, bad = quality.quarantine(_prepared(spark, sf), quality.prediction_rules())
    sides = [
        side.agg(F.lit(flag).alias("quarantined"), F.count("*").alias("row_count"))
        for side, flag in ((good, False), (bad, True))
    ]
    return sides[0].unionByName(sides[1])


@query(
    "l6_decimal_overflow",
    DIRT + "SELECT subscription_id, cutoff_date::VARCHAR AS cutoff_date FROM dirty"
    " WHERE TRY_CAST(predicted_sales AS DECIMAL(8,2)) IS NULL",
)
def l6(spark, sf):
    overflow = [r for r in quality.prediction_rules() if "overflows" in r[0]]
    found = quality.violations(_prepared(spark, sf), overflow, ["subscription_id", "cutoff_date"])
    return found.drop("rule")


@query(
    "l7_orphan_predictions",
    DIRT + "SELECT subscription_id, cutoff_date::VARCHAR AS cutoff_date, run_id FROM dirty"
    " WHERE run_id NOT IN (SELECT run_id FROM telemetry)",
)
def l7(spark, sf):
    found = quality.orphans(testbed.dirty_predictions(spark, sf), testbed.telemetry(spark, sf))
    return found.select("subscription_id", "cutoff_date", "run_id")


@query(
    "l8_cascading_delete",
    BASE + "SELECT run_id, count(*) AS row_count FROM predictions WHERE run_id NOT IN"
    " (SELECT run_id FROM telemetry WHERE drift_flag) GROUP BY 1",
)
def l8(spark, sf):
    predictions, telemetry = _tables(spark, sf)
    left = quality.without_runs(predictions, telemetry.filter("drift_flag"))
    return left.groupBy("run_id").agg(F.count("*").alias("row_count"))


@query(
    "l9_integrity_summary",
    DIRT + "SELECT (count(*) FILTER (prescriptive_action IS NULL) + count(*) FILTER (prescribed_risk_drop IS NULL))"
    " AS null_count, count(*) FILTER (sales_lower_bound > sales_upper_bound) AS interval_violations FROM dirty",
)
def l9(spark, sf):
    return quality.integrity_summary(_prepared(spark, sf))


@query(
    "l9b_high_risk_sample",
    BASE + "SELECT customer_id, subscription_id, cutoff_date::VARCHAR AS cutoff_date,"
    " churn_probability::DOUBLE AS churn_probability, predicted_sales::DOUBLE AS predicted_sales,"
    " prescriptive_action, prescribed_risk_drop::DOUBLE AS prescribed_risk_drop FROM predictions"
    " WHERE churn_probability > 0.65 ORDER BY subscription_id, predictions.cutoff_date LIMIT 5",
)
def l9b(spark, sf):
    return quality.high_risk_sample(
        testbed.predictions(spark, sf), ["subscription_id", "cutoff_date"], rows=5
    )


@query(
    "l10_unknown_accounts",
    with_(RAW) + "SELECT subscription_id, account_id FROM subscriptions WHERE account_id NOT IN"
    " (SELECT account_id FROM accounts WHERE industry <> 'BUILDING')",
)
def l10(spark, sf):
    known = testbed.accounts(spark, sf).filter("industry <> 'BUILDING'")
    lost = quality.unknown_accounts(testbed.subscriptions(spark, sf), known)
    return lost.select("subscription_id", "account_id")


@query(
    "l11_duplicate_keys",
    "SELECT l_orderkey AS subscription_id, count(*) AS \"rows\" FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def l11(spark, sf):
    return quality.duplicate_keys(testbed.usage(spark, sf), "subscription_id")


# --- M: views ---

RUN = (
    "run_id, model_version, churn_auc::DOUBLE AS churn_auc, sales_mape::DOUBLE AS sales_mape,"
    " sales_rmse::DOUBLE AS sales_rmse, sales_mae::DOUBLE AS sales_mae, sales_wmape::DOUBLE AS sales_wmape,"
    " psi_score::DOUBLE AS psi_score, drift_flag, risk_threshold::DOUBLE AS risk_threshold"
)


@query(
    "m1_latest_run",
    TOP + f"SELECT {RUN}, risk_queue_lift::DOUBLE AS risk_queue_lift, created_at AS run_timestamp FROM latest_run",
)
def m1(spark, sf):
    return views.latest_run(testbed.telemetry(spark, sf))


@query(
    "m2_latest_predictions",
    TOP + f"SELECT {RUN}, risk_queue_lift::DOUBLE AS risk_queue_lift, run_timestamp, customer_id, subscription_id,"
    " cutoff_date::VARCHAR AS cutoff_date, actual_churn, churn_probability::DOUBLE AS churn_probability, risk_tier,"
    " actual_sales::DOUBLE AS actual_sales, predicted_sales::DOUBLE AS predicted_sales,"
    " sales_lower_bound::DOUBLE AS sales_lower_bound, sales_upper_bound::DOUBLE AS sales_upper_bound,"
    " (sales_upper_bound - sales_lower_bound)::DOUBLE AS interval_spread, prescriptive_action,"
    " prescribed_risk_drop::DOUBLE AS prescribed_risk_drop,"
    " (churn_probability - prescribed_risk_drop)::DOUBLE AS risk_reduction_delta, is_recoverable_revenue,"
    " created_at AS prediction_timestamp FROM latest",
)
def m2(spark, sf):
    return _latest(spark, sf)


@query("m3_risk_tiers", TOP + "SELECT risk_tier, count(*) AS customers FROM latest GROUP BY 1")
def m3(spark, sf):
    return _latest(spark, sf).groupBy("risk_tier").agg(F.count("*").alias("customers"))


@query(
    "m3b_tiers_without_threshold",
    BASE + "SELECT subscription_id, CASE WHEN churn_probability >= 0.75 THEN 'Tier 1 - Critical Risk (>75%)'"
    " WHEN churn_probability >= 0.50 THEN 'Tier 2 - Elevated Risk (50-75%)'"
    " WHEN churn_probability >= 0.25 THEN 'Tier 3 - Moderate Risk (25-50%)' ELSE 'Tier 4 - Stable (<25%)' END"
    " AS risk_tier FROM predictions WHERE run_id = 'run-1999-07'",
)
def m3b(spark, sf):
    predictions, telemetry = _tables(spark, sf)
    july = telemetry.filter("run_id = 'run-1999-07'")
    return views.latest_predictions(predictions, july).select("subscription_id", "risk_tier")


@query(
    "m4_spread_and_delta",
    TOP + "SELECT subscription_id, (sales_upper_bound - sales_lower_bound)::DOUBLE AS interval_spread,"
    " (churn_probability - prescribed_risk_drop)::DOUBLE AS risk_reduction_delta FROM latest",
)
def m4(spark, sf):
    return _latest(spark, sf).select("subscription_id", "interval_spread", "risk_reduction_delta")


@query(
    "m5_recoverable_flag",
    TOP + "SELECT is_recoverable_revenue, count(*) AS customers FROM latest GROUP BY 1",
)
def m5(spark, sf):
    return _latest(spark, sf).groupBy("is_recoverable_revenue").agg(F.count("*").alias("customers"))


@query(
    "m6_drift_governance",
    BASE + f"SELECT {RUN}, risk_queue_count, risk_queue_recall::DOUBLE AS risk_queue_recall,"
    " risk_queue_precision::DOUBLE AS risk_queue_precision, risk_queue_lift::DOUBLE AS risk_queue_lift,"
    " CASE WHEN psi_score < 0.10 THEN 'Stable (No Shift)' WHEN psi_score <= 0.20 THEN 'Moderate Shift (Monitor)'"
    " ELSE 'Critical Drift (Action Required)' END AS drift_status_label, test_sample_count, notes,"
    " created_at AS run_timestamp FROM telemetry",
)
def m6(spark, sf):
    return views.drift_governance(testbed.telemetry(spark, sf))


QUEUE = (
    "SELECT customer_id, subscription_id, cutoff_date::VARCHAR AS cutoff_date,"
    " churn_probability::DOUBLE AS churn_probability, predicted_sales::DOUBLE AS predicted_sales,"
    " (churn_probability * predicted_sales)::DOUBLE AS expected_revenue_loss, prescriptive_action,"
    " prescribed_risk_drop::DOUBLE AS prescribed_risk_drop,"
    " (churn_probability - prescribed_risk_drop)::DOUBLE AS expected_risk_reduction, p.run_id, p.created_at"
    " FROM predictions p LEFT JOIN (SELECT run_id, risk_threshold FROM telemetry) t USING (run_id)"
    " WHERE churn_probability >= coalesce(risk_threshold, 0.50)"
)


@query("m7_retention_queue", BASE + QUEUE)
def m7(spark, sf):
    return views.retention_queue(*_tables(spark, sf))


@query("m7b_latest_retention_queue", BASE + QUEUE + " AND p.run_id = 'run-1999-09'")
def m7b(spark, sf):
    return views.retention_queue(*_tables(spark, sf), latest_only=True)


# --- N: measures ---


@query("n1_total_expected_mrr", BASE + "SELECT sum(predicted_sales)::DOUBLE AS total_expected_mrr FROM predictions")
def n1(spark, sf):
    return measures.total_expected_mrr(testbed.predictions(spark, sf))


QUEUED = "FILTER (churn_probability >= (SELECT max(risk_threshold) FROM telemetry)"


@query("n2_revenue_in_queue", BASE + f"SELECT (sum(predicted_sales) {QUEUED}))::DOUBLE AS revenue_in_queue FROM predictions")
def n2(spark, sf):
    return measures.queue_measures(*_tables(spark, sf)).select("revenue_in_queue")


@query(
    "n3_recoverable_revenue",
    BASE + f"SELECT (sum(predicted_sales) {QUEUED} AND prescribed_risk_drop < churn_probability))::DOUBLE"
    " AS recoverable_revenue FROM predictions",
)
def n3(spark, sf):
    return measures.queue_measures(*_tables(spark, sf)).select("recoverable_revenue")


@query(
    "n4_drift_status_text",
    TOP + "SELECT CASE WHEN count(DISTINCT drift_flag) = 1 AND bool_and(drift_flag) THEN '⚠️ CRITICAL DRIFT DETECTED'"
    " ELSE '✅ MODELS STABLE (Overall PSI < 0.20; Calendar Aging Documented)' END AS drift_status_text"
    " FROM latest_run",
)
def n4(spark, sf):
    return measures.drift_status_text(views.latest_run(testbed.telemetry(spark, sf)))


@query(
    "n4b_drift_status_mixed",
    BASE + "SELECT CASE WHEN count(DISTINCT drift_flag) = 1 AND bool_and(drift_flag) THEN '⚠️ CRITICAL DRIFT DETECTED'"
    " ELSE '✅ MODELS STABLE (Overall PSI < 0.20; Calendar Aging Documented)' END AS drift_status_text"
    " FROM telemetry",
)
def n4b(spark, sf):
    return measures.drift_status_text(testbed.telemetry(spark, sf))


@query(
    "n5_queue_selection_rate",
    BASE + f"SELECT (count(*) {QUEUED}))::DOUBLE / count(*)::DOUBLE AS queue_selection_rate FROM predictions",
)
def n5(spark, sf):
    return measures.queue_measures(*_tables(spark, sf)).select("queue_selection_rate")


@query(
    "n6_average_interval_spread",
    BASE + "SELECT sum(sales_upper_bound - sales_lower_bound)::DOUBLE / count(*)::DOUBLE AS avg_interval_spread"
    " FROM predictions",
)
def n6(spark, sf):
    return measures.average_interval_spread(testbed.predictions(spark, sf))


AT_CUT = (
    "SELECT *, revenue_at_risk * 100 / total_sales AS at_risk_pct,"
    " recoverable_revenue * 100 / revenue_at_risk AS recoverable_pct"
    " FROM (SELECT sum(predicted_sales)::DOUBLE AS total_sales,"
    " (sum(predicted_sales) FILTER (churn_probability >= {cut}))::DOUBLE AS revenue_at_risk,"
    " (sum(predicted_sales) FILTER (churn_probability >= {cut} AND prescribed_risk_drop < 0.35))::DOUBLE"
    " AS recoverable_revenue, count(*) AS customers FROM latest)"
)


@query("n7_exposure_at_cut", TOP + AT_CUT.format(cut="0.30"))
def n7(spark, sf):
    return measures.exposure_at_cut(_latest(spark, sf), cut=0.30)


@query("n8_exposure_shares", TOP + f"SELECT at_risk_pct, recoverable_pct FROM ({AT_CUT.format(cut='0.40')})")
def n8(spark, sf):
    return measures.exposure_at_cut(_latest(spark, sf), cut=0.40).select("at_risk_pct", "recoverable_pct")


@query("n9_tier_list", TOP + "SELECT DISTINCT risk_tier FROM latest")
def n9(spark, sf):
    return measures.tier_list(_latest(spark, sf))


@query(
    "n9b_tier_filter",
    TOP + "SELECT subscription_id, risk_tier FROM latest WHERE risk_tier IN"
    " ('Tier 1 - Critical Risk (>75%)', 'Tier 4 - Stable (<25%)')",
)
def n9b(spark, sf):
    chosen = ["Tier 1 - Critical Risk (>75%)", "Tier 4 - Stable (<25%)"]
    return measures.in_tiers(_latest(spark, sf), chosen).select("subscription_id", "risk_tier")


@query("n10_customer_search", TOP + "SELECT customer_id, subscription_id FROM latest WHERE customer_id LIKE '%42%'")
def n10(spark, sf):
    return measures.search_customers(_latest(spark, sf), " 42 ").select("customer_id", "subscription_id")


@query(
    "n10b_customer_search_regex",
    TOP + "SELECT customer_id, subscription_id FROM latest WHERE regexp_matches(customer_id, '^1.*7$')",
)
def n10b(spark, sf):
    found = measures.search_customers(_latest(spark, sf), "^1.*7$", regex=True)
    return found.select("customer_id", "subscription_id")


@query(
    "n11_systematic_sample",
    TOP + "SELECT 'Sub-' || ((rn - 1) // step + 1) AS subscriber_idx, subscription_id,"
    " predicted_sales::DOUBLE AS predicted_sales FROM (SELECT *, row_number() OVER"
    " (ORDER BY predicted_sales, subscription_id) AS rn, greatest(1, count(*) OVER () // 60) AS step FROM latest)"
    " WHERE (rn - 1) % step = 0",
)
def n11(spark, sf):
    sample = measures.systematic_sample(_latest(spark, sf), ["subscription_id"], target=60)
    return sample.select("subscriber_idx", "subscription_id", "predicted_sales")


@query(
    "n12_priority_table",
    TOP + "SELECT customer_id, subscription_id, risk_tier,"
    " printf('%.1f%%', churn_probability::DOUBLE * 100) AS churn_risk,"
    " '$' || format('{:,.2f}', predicted_sales::DOUBLE) AS monthly_spend, prescriptive_action,"
    " printf('%.1f%%', prescribed_risk_drop::DOUBLE * 100) AS post_intervention_risk,"
    " is_recoverable_revenue FROM latest WHERE churn_probability >= 0.50",
)
def n12(spark, sf):
    return measures.priority_table(_latest(spark, sf), ties=["customer_id", "subscription_id"])


@query(
    "n13_spend_deciles",
    TOP + "SELECT decile, sum(sales_lower_bound)::DOUBLE / count(*) AS sales_lower_bound,"
    " sum(predicted_sales)::DOUBLE / count(*) AS predicted_sales,"
    " sum(sales_upper_bound)::DOUBLE / count(*) AS sales_upper_bound, count(*) AS customers FROM"
    " (SELECT *, (ntile(10) OVER (ORDER BY predicted_sales, subscription_id))::INT AS decile FROM latest) GROUP BY 1",
)
def n13(spark, sf):
    return measures.spend_deciles(_latest(spark, sf), ["subscription_id"])


@query(
    "n14_scoring_summary",
    BASE + "SELECT *, high_risk_customers * 100.0::DOUBLE / customers AS high_risk_pct,"
    " revenue_at_risk * 100 / total_sales AS at_risk_pct,"
    " recoverable_revenue * 100 / revenue_at_risk AS recoverable_pct FROM (SELECT count(*) AS customers,"
    " count(*) FILTER (churn_probability >= 0.50) AS high_risk_customers,"
    " sum(predicted_sales)::DOUBLE AS total_sales,"
    " (sum(predicted_sales) FILTER (churn_probability >= 0.50))::DOUBLE AS revenue_at_risk,"
    " (sum(predicted_sales) FILTER (churn_probability >= 0.50 AND prescribed_risk_drop < 0.35))::DOUBLE"
    " AS recoverable_revenue, sum(sales_upper_bound)::DOUBLE / count(*)"
    " - sum(sales_lower_bound)::DOUBLE / count(*) AS avg_interval_band FROM predictions)",
)
def n14(spark, sf):
    return measures.scoring_summary(testbed.predictions(spark, sf))


@query(
    "n15_run_header",
    TOP + "SELECT model_version, created_at AS run_timestamp, psi_score::DOUBLE AS psi_score, drift_flag,"
    " churn_auc::DOUBLE AS churn_auc, sales_mape::DOUBLE AS sales_mape FROM latest_run",
)
def n15(spark, sf):
    return measures.run_header(testbed.telemetry(spark, sf))


# --- K1: generated ids ---


@query(
    "k1_customer_ids",
    "SELECT o_orderkey, 'CUST-' || lpad((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::VARCHAR, 5, '0')"
    " AS customer_id FROM orders",
)
def k1(spark, sf):
    orders = testbed.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return with_customer_id(orders, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("k1b_customer_ids_from_accounts", with_(RAW) + "SELECT subscription_id, account_id::VARCHAR AS customer_id FROM subscriptions")
def k1b(spark, sf):
    return with_customer_id(testbed.subscriptions(spark, sf)).select("subscription_id", "customer_id")


