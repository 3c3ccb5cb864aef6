"""Contract reports, quarantined input, reconciled telemetry and one leaf-wise tree."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from checks import q_serving, testbed  # noqa: F401  the serving queries are registered first
from checks.q_features import SNAPS, raw_files, scratch, snapshots
from checks.q_models import RECOURSE, THRESHOLD
from checks.registry import QUERIES, SQL, query
from checks.sql import ACTIVE, RAW, SCORED, SERVING, with_
from foresight import contract
from foresight.models.leafwise import MIN_GAIN, UNIT, LeafwiseLearner
from foresight.models.prep import churn_preprocessor, sales_preprocessor
from foresight.operators import drift, reconcile, reports
from foresight.operators.split import temporal_split
from foresight.plans.build import run_snapshot_job
from foresight.session import cut_lineage, stored
from foresight.sources.raw import load_raw, read_quarantined

BASE = with_(RAW, ACTIVE, SCORED, SERVING)


# --- A2: bad values set aside ---

BAD_DATE, BAD_COUNT = 97, 89


@query(
    "a2b_quarantined_rows",
    with_(RAW)
    + "SELECT subscription_id::VARCHAR AS subscription_id, bad_columns, count(*) AS row_count FROM ("
    f" SELECT subscription_id, concat_ws(',', CASE WHEN subscription_id % {BAD_DATE} = 0 THEN 'usage_date' END,"
    f" CASE WHEN subscription_id % {BAD_COUNT} = 0 THEN 'usage_count' END) AS bad_columns FROM usage) GROUP BY 1, 2",
)
def a2b(spark, sf):
    """Files with broken dates and fractions: bad rows keep their text, the others are typed."""
    folder, at = scratch(spark), F.col("subscription_id")
    damaged = testbed.usage(spark, sf).withColumns(
        {
            "usage_date": F.when(at % BAD_DATE == 0, "some day").otherwise(F.col("usage_date").cast("string")),
            "usage_count": F.when(at % BAD_COUNT == 0, "1.5").otherwise(F.concat("usage_count", F.lit(".0"))),
        }
    )
    damaged.write.option("header", True).csv(f"{folder}/feature_usage.csv")
    good, bad = read_quarantined(spark, folder, "feature_usage")
    found = good.select("subscription_id", F.lit("").alias("bad_columns")).unionByName(
        bad.select("subscription_id", F.array_join("bad_columns", ",").alias("bad_columns"))
    )
    return found.groupBy("subscription_id", "bad_columns").agg(F.count("*").alias("row_count"))


# --- I1, K5, L1, L3: reports over good and damaged tables ---


def _both(good, damaged):
    return good.withColumn("state", F.lit("good")).unionByName(damaged.withColumn("state", F.lit("damaged")))


def _required_sql(source: str, subject: str, required, nulled: dict[str, str], absent: str) -> str:
    rows = []
    for state in ("good", "damaged"):
        for c in required:
            test = f"{c} IS NULL" + (f" OR {nulled[c]}" if state == "damaged" and c in nulled else "")
            rows.append((state, f"{c} given", "true" if state == "damaged" and c == absent else test))
        rows.append((state, "has rows", "false"))
    selects = [
        f"SELECT '{state}' AS state, '{subject}' AS subject, '{rule}' AS rule, count(*) FILTER ({test}) AS broken_rows"
        f" FROM {source}"
        for state, rule, test in rows
    ]
    return (
        "SELECT *, CASE WHEN broken_rows > 0 THEN 'broken' ELSE 'ok' END AS verdict FROM ("
        + " UNION ALL ".join(selects) + ")"
    )


@query(
    "l1_telemetry_report",
    BASE + _required_sql("telemetry", "telemetry", contract.REQUIRED_TELEMETRY, {"churn_auc": "run_id >= 'run-1999-08'"}, "sales_rmse"),
)
def l1(spark, sf):
    good = testbed.telemetry(spark, sf)
    late = F.col("run_id") >= "run-1999-08"
    damaged = good.drop("sales_rmse").withColumn("churn_auc", F.when(~late, F.col("churn_auc")))
    return _both(reports.telemetry_report(good), reports.telemetry_report(damaged))


@query(
    "l3_prediction_report",
    BASE
    + _required_sql(
        "predictions", "predictions", contract.REQUIRED_PREDICTION,
        {"customer_id": "subscription_id % 59 = 0", "predicted_sales": "subscription_id % 61 = 0"}, "prescriptive_action",
    ),
)
def l3(spark, sf):
    good, at = testbed.predictions(spark, sf), F.col("subscription_id")
    damaged = good.drop("prescriptive_action").withColumns(
        {
            "customer_id": F.when(at % 59 != 0, F.col("customer_id")),
            "predicted_sales": F.when(at % 61 != 0, F.col("predicted_sales")),
        }
    )
    return _both(reports.prediction_report(good), reports.prediction_report(damaged))


_HOLDOUT = f"cutoff_date >= DATE '{testbed.HOLDOUT_START}'"


@query(
    "k5_split_report",
    with_(RAW, ACTIVE, SCORED)
    + "SELECT 'split' AS subject, *, CASE WHEN broken_rows > 0 THEN 'broken' ELSE 'ok' END AS verdict FROM ("
    " SELECT 'good' AS state, unnest(['train has rows', 'holdout has rows', 'train before holdout']) AS rule,"
    " 0::BIGINT AS broken_rows"
    " UNION ALL SELECT 'damaged', 'train has rows', 0"
    " UNION ALL SELECT 'damaged', 'holdout has rows', 0"
    f" UNION ALL SELECT 'damaged', 'train before holdout', count(*) FILTER ({_HOLDOUT}) FROM scored"
    " UNION ALL SELECT 'empty', 'train has rows', 0"
    " UNION ALL SELECT 'empty', 'holdout has rows', 1"
    " UNION ALL SELECT 'empty', 'train before holdout', 0)",
)
def k5(spark, sf):
    """A right split, one whose train side keeps the holdout's months, and one without a holdout."""
    data = testbed.scored(spark, sf)
    train, holdout = temporal_split(data, split_date=testbed.HOLDOUT_START)
    empty = reports.split_report(train, holdout.filter("false")).withColumn("state", F.lit("empty"))
    return _both(reports.split_report(train, holdout), reports.split_report(data, holdout)).unionByName(empty)


@query(
    "i1_mutability_report",
    RECOURSE
    + "SELECT *, CASE WHEN changed_rows > 0 AND NOT mutable THEN 'broken' ELSE 'ok' END AS verdict FROM ("
    + " UNION ALL ".join(
        f"SELECT '{state}' AS state, '{c}' AS feature, {str(c in contract.MUTABLE).lower()} AS mutable, "
        + (
            f"(SELECT count(*) FROM changed n JOIN contracts c USING (subscription_id, cutoff_date)"
            f" WHERE n.{c} IS DISTINCT FROM c.{c})"
            if c in contract.MUTABLE
            else "(SELECT count(*) FROM changed WHERE subscription_id % 101 = 0)"
            if (state, c) == ("damaged", "seats")
            else "0::BIGINT"
        )
        + " AS changed_rows"
        for state in ("good", "damaged")
        for c in contract.FEATURES
    )
    + ")",
)
def i1(spark, sf):
    """What the actions change over all holdout snapshots; a damaged action also sells seats."""
    holdout = F.col("cutoff_date") >= F.lit(testbed.HOLDOUT_START).cast("date")
    rows = stored(snapshots(spark, sf).filter(holdout))  # one reader a report

    def overselling(df):
        more = F.when(F.col("subscription_id") % 101 == 0, F.col("seats") + 1).otherwise(F.col("seats"))
        return reports.apply_candidate(df).withColumn("seats", more)

    return _both(reports.mutability_report(rows), reports.mutability_report(rows, change=overselling))


# --- K3: telemetry against the predictions it was computed from ---

_FIGURES = ", ".join(reconcile.TOLERANCES)
RECOMPUTED = (
    BASE.rstrip()
    + """,
ranked AS (
  SELECT p.*, t.risk_threshold::DOUBLE AS threshold,
    rank() OVER (PARTITION BY p.run_id ORDER BY p.churn_probability)
      + (count(*) OVER (PARTITION BY p.run_id, p.churn_probability) - 1) / 2.0 AS r,
    abs(p.actual_sales::DOUBLE - p.predicted_sales::DOUBLE) AS e, p.actual_sales::DOUBLE AS y
  FROM predictions p JOIN telemetry t ON t.run_id = p.run_id),
sums AS (
  SELECT run_id, count(*) AS n, sum(actual_churn)::DOUBLE AS pos, sum(r) FILTER (actual_churn = 1) AS ranks,
    any_value(threshold) AS threshold, coalesce(avg(e / y) FILTER (y > 0), 0.0) AS sales_mape,
    sqrt(avg(e * e)) AS sales_rmse, avg(e) AS sales_mae, sum(e) / sum(abs(y)) AS sales_wmape,
    (count(*) FILTER (churn_probability::DOUBLE >= threshold))::DOUBLE AS queued,
    (count(*) FILTER (churn_probability::DOUBLE >= threshold AND actual_churn = 1))::DOUBLE AS captured
  FROM ranked GROUP BY run_id),
figures AS (
  SELECT run_id, n AS test_sample_count,
    CASE WHEN pos IN (0, n) THEN 0.5 ELSE (ranks - pos * (pos + 1) / 2) / (pos * (n - pos)) END AS churn_auc,
    sales_mape, sales_rmse, sales_mae, sales_wmape, CASE WHEN threshold IS NOT NULL THEN queued END AS risk_queue_count,
    CASE WHEN threshold IS NOT NULL THEN coalesce(captured / nullif(pos, 0), 0) END AS risk_queue_recall,
    CASE WHEN threshold IS NOT NULL THEN coalesce(captured / nullif(queued, 0), 0) END AS risk_queue_precision,
    CASE WHEN threshold IS NOT NULL THEN coalesce(coalesce(captured / nullif(queued, 0), 0) / nullif(pos / n, 0), 0) END
      AS risk_queue_lift
  FROM sums)
"""
)
_LONG = (
    "(SELECT run_id, unnest(["
    + ", ".join(f"{{{{metric: '{m}', v: {m}::DOUBLE}}}}".replace("{{", "{").replace("}}", "}") for m in reconcile.TOLERANCES)
    + "], recursive := true) FROM figures)"
)


@query(
    "k3b_recomputed_figures",
    RECOMPUTED + f"SELECT run_id, metric, round(v, 6) AS v FROM {_LONG} WHERE v IS NOT NULL",
)
def k3b(spark, sf):
    figures = reconcile.run_metrics(testbed.predictions(spark, sf), testbed.telemetry(spark, sf))
    long = figures.select("run_id", *[F.col(m).cast("double").alias(m) for m in reconcile.TOLERANCES])
    return long.unpivot("run_id", list(reconcile.TOLERANCES), "metric", "v").filter("v IS NOT NULL").withColumn("v", F.round("v", 6))


@query(
    "k3c_tampered_telemetry",
    RECOMPUTED
    + "SELECT run_id, metric, round(v + CASE metric WHEN 'sales_mae' THEN 1 ELSE -1 END, 4) AS stored,"
    f" round(v, 4) AS recomputed FROM {_LONG} WHERE run_id = 'run-1999-08' AND metric = 'sales_mae'"
    " OR run_id = 'run-1999-09' AND metric = 'test_sample_count'",
)
def k3c(spark, sf):
    """Telemetry logged from the predictions' own figures bears the audit out; two changed figures are found."""
    predictions, telemetry = testbed.predictions(spark, sf), testbed.telemetry(spark, sf)
    figures = cut_lineage(reconcile.run_metrics(predictions, telemetry))
    stored = telemetry.select("run_id", "risk_threshold").join(figures, "run_id")
    mae = F.col("sales_mae") + (F.col("run_id") == "run-1999-08").cast("int")
    count = F.col("test_sample_count") - (F.col("run_id") == "run-1999-09").cast("int")
    tampered = stored.withColumns({"sales_mae": mae, "test_sample_count": count})
    found = reconcile.reconcile(stored, predictions).unionByName(reconcile.reconcile(tampered, predictions))
    return found.select("run_id", "metric", F.round("stored", 4).alias("stored"), F.round("recomputed", 4).alias("recomputed"))


# --- G4: one leaf-wise tree, grown again in SQL ---

GROWN_ON = {
    "active_tenure_days": [90, 180, 360, 540],
    "seats": [10, 25],
    "usage_count_30d": [0, 30, 60],
    "ticket_count_60d": [0, 1, 3],
    "account_age_days": [180, 360],
}
LEAVES, MIN_LEAF, STEP = 31, 20, 0.08


def _bin_sql(column: str, edges: list[int]) -> str:
    return " + ".join(f"({column} > {e})::INT" for e in edges)


ONE_TREE = (
    SNAPS.rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    + f""",
binned AS (
  SELECT {", ".join(f"{_bin_sql(c, e)} AS b{i}" for i, (c, e) in enumerate(GROWN_ON.items()))}, churn_next_30d AS y
  FROM snapshots WHERE account_age_days IS NOT NULL),
cells AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY b0, b1, b2, b3, b4) AS cell, [b0, b1, b2, b3, b4] AS b,
    count(*) AS n, sum(y)::BIGINT AS pos FROM binned GROUP BY b0, b1, b2, b3, b4),
base AS (SELECT sum(pos)::DOUBLE / sum(n) AS p FROM cells),
units AS MATERIALIZED (
  SELECT cell, b, n, (n - pos) * round_even(p * {UNIT}, 0) + pos * round_even((p - 1) * {UNIT}, 0) AS g,
    n * round_even(p * (1 - p) * {UNIT}, 0) AS h FROM cells, base),
grown AS (
  SELECT 1 AS leaves, (SELECT list({{cell: cell, leaf: 1}} ORDER BY cell) FROM units) AS place
  UNION ALL
  SELECT leaves + 1, next FROM (
    SELECT leaves, (
      WITH located AS (
        SELECT l.leaf, u.* FROM (SELECT unnest(place, recursive := true)) l JOIN units u ON u.cell = l.cell),
      totals AS (SELECT leaf, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM located GROUP BY leaf),
      candidates AS (
        SELECT leaf, f, e, sum(g) FILTER (b[f] <= e) AS g, sum(h) FILTER (b[f] <= e) AS h, sum(n) FILTER (b[f] <= e) AS n
        FROM located, (SELECT unnest([{", ".join(f"{{f: {i + 1}, e: {k}}}" for i, e in enumerate(GROWN_ON.values()) for k in range(len(e)))}], recursive := true))
        GROUP BY leaf, f, e),
      best AS (
        SELECT c.leaf, f, e FROM candidates c JOIN totals t ON t.leaf = c.leaf
        WHERE c.n >= {MIN_LEAF} AND t.n - c.n >= {MIN_LEAF}
          AND c.g / c.h * c.g + (t.g - c.g) / (t.h - c.h) * (t.g - c.g) - t.g / t.h * t.g
            > {MIN_GAIN}::DOUBLE * (c.g / c.h * c.g + (t.g - c.g) / (t.h - c.h) * (t.g - c.g))
        ORDER BY c.g / c.h * c.g + (t.g - c.g) / (t.h - c.h) * (t.g - c.g) - t.g / t.h * t.g DESC, c.leaf, f, e LIMIT 1)
      SELECT list({{cell: l.cell, leaf: CASE WHEN l.leaf = best.leaf AND l.b[best.f] > best.e THEN leaves + 1 ELSE l.leaf END}}
        ORDER BY l.cell) FROM located l, best) AS next
    FROM grown WHERE leaves < {LEAVES})
  WHERE next IS NOT NULL),
final AS (SELECT unnest(place, recursive := true) FROM grown WHERE leaves = (SELECT max(leaves) FROM grown))
SELECT leaf_value, sum(cells)::BIGINT AS row_cells, sum(n)::BIGINT AS leaf_rows,
  (SELECT max(leaves) FROM grown)::INT AS n_leaves
FROM (SELECT round(-{STEP} * sum(u.g) / sum(u.h), 9) AS leaf_value, count(*) AS cells, sum(u.n) AS n
  FROM final f JOIN units u ON u.cell = f.cell GROUP BY f.leaf) GROUP BY leaf_value
"""
)


@query("g4b_leafwise_tree", ONE_TREE)
def g4b(spark, sf):
    """The first tree on five binned features: its leaf values (pure leaves share one) with their rows."""
    known = snapshots(spark, sf).filter("account_age_days IS NOT NULL")
    features = array_to_vector(F.array(*[F.col(c).cast("double") for c in GROWN_ON]))
    rows = cut_lineage(known.select(features.alias("features"), F.col(contract.CHURN_TARGET).alias("y"), *GROWN_ON))
    edges = [np.array(e, dtype=float) for e in GROWN_ON.values()]
    (trees,) = LeafwiseLearner(1, STEP, LEAVES, MIN_LEAF).fit(rows, "y", edges=edges)
    scored = rows.withColumn("value", trees.column() - trees.start)
    bins = F.concat_ws(
        ",", *[sum(((F.col(c) > e).cast("int") for e in given[1:]), (F.col(c) > given[0]).cast("int")) for c, given in GROWN_ON.items()]
    )
    return scored.groupBy(F.round("value", 9).alias("leaf_value")).agg(
        F.count_distinct(bins).alias("row_cells"),
        F.count("*").alias("leaf_rows"),
        F.lit(sum(f < 0 for f in trees.trees[0].feature)).alias("n_leaves"),
    )


# --- Twins over whole rows and slots beside those over counts ---


@query(
    "a1b_raw_usage_rows",
    with_(RAW)
    + "SELECT subscription_id::VARCHAR AS subscription_id, usage_date, feature_name, usage_count, usage_duration_secs,"
    " error_count, is_beta_feature FROM usage",
)
def a1b(spark, sf):
    return load_raw(spark, raw_files(spark, sf), fmt="csv")["feature_usage"]


@query(
    "a1c_raw_contract_rows",
    with_(RAW)
    + "SELECT subscription_id::VARCHAR AS subscription_id, account_id::VARCHAR AS account_id, start_date, end_date,"
    " plan_tier, seats, mrr_amount, arr_amount, is_trial, billing_frequency,"
    " coalesce(auto_renew_flag, false) AS auto_renew_flag FROM subscriptions",
)
def a1c(spark, sf):
    """Missing flags count as false; columns that the files lack stay away."""
    return load_raw(spark, raw_files(spark, sf), fmt="csv")["subscriptions"]


@query(
    "e5b_snapshot_job_rows",
    SNAPS
    + "SELECT subscription_id::VARCHAR AS subscription_id, account_id::VARCHAR AS account_id, "
    + ", ".join(c for c in contract.SNAPSHOT_COLUMNS if c not in ("subscription_id", "account_id"))
    + " FROM snapshots",
)
def e5b(spark, sf):
    """Every row of the table that the whole job saves."""
    return run_snapshot_job(spark, raw_files(spark, sf), scratch(spark), testbed.CUTOFFS)


def _slots_sql(numeric) -> str:
    rows = [
        f"SELECT '{c}' AS slot, round(sum(abs({c} - m) / s), 2) AS total FROM snapshots, (SELECT avg({c}) AS m,"
        f" CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s FROM snapshots)"
        for c in numeric
    ]
    rows += [
        f"SELECT '{c}=' || coalesce({c}, '__NULL__'), count(*)::DOUBLE FROM snapshots GROUP BY 1" for c in contract.CATEGORICAL
    ]
    rows += [f"SELECT '{c}', sum({c})::DOUBLE FROM snapshots" for c in contract.BOOLEAN]
    return SNAPS + " UNION ALL ".join(rows)


def _slots(spark, sf, preprocessor):
    """What each slot of the model matrix adds up to (numbers without their sign), by the slot's meaning."""
    rows = stored(snapshots(spark, sf))
    fitted = preprocessor.fit(rows)
    indexer = fitted.encoder.stages[0]
    labels = [f"{c}={label}" for c, found in zip(fitted.categorical, indexer.labelsArray, strict=True) for label in found]
    names = [*fitted.statistics, *labels, *contract.BOOLEAN]
    x = fitted.transform(rows).select(vector_to_array("features").alias("x"))
    sums = x.agg(*[F.sum(F.abs(F.col("x")[i])).alias(f"s{i}") for i in range(len(names))], F.max(F.size("x")).alias("width"))
    total = F.array(*[F.struct(F.lit(n).alias("slot"), F.round(f"s{i}", 2).alias("total")) for i, n in enumerate(names)])
    complete = F.when(F.col("width") == len(names), total)  # no slot is left unnamed
    return sums.select(F.explode(complete).alias("r")).select("r.*")


@query("f2b_churn_matrix_slots", _slots_sql(contract.NUMERIC))
def f2b(spark, sf):
    return _slots(spark, sf, churn_preprocessor())


@query("f4b_sales_matrix_slots", _slots_sql(contract.SALES_NUMERIC))
def f4b(spark, sf):
    return _slots(spark, sf, sales_preprocessor())


@query(
    "j4b_sides_of_missing_values",
    """
WITH base AS (SELECT c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0),
target AS (SELECT c_acctbal AS v FROM customer WHERE c_custkey = 1),
edges AS (
  SELECT list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM base),
inside AS (SELECT e[2:len(e) - 1] AS e, len(e) - 1 AS k FROM edges),
counted AS (
  SELECT len(list_filter(e, lambda x: x <= v)) AS bin, is_target
  FROM (SELECT v, 0 AS is_target FROM base UNION ALL SELECT v, 1 FROM target), inside),
shares AS (
  SELECT bin, ((SELECT count(*) FROM counted c WHERE c.bin = b.bin AND is_target = 0) + 1e-4)
      / ((SELECT count(*) FROM base) + k * 1e-4) AS p,
    ((SELECT count(*) FROM counted c WHERE c.bin = b.bin AND is_target = 1) + 1e-4)
      / ((SELECT count(*) FROM target) + k * 1e-4) AS q
  FROM inside, (SELECT unnest(range(0, (SELECT k FROM inside))) AS bin) b)
SELECT 'c_acctbal' AS feature, round(sum((q - p) * ln(q / p)), 4) AS psi FROM shares
UNION ALL SELECT 'c_nothing', 0.0 UNION ALL SELECT 'c_one_sided', 0.0
""",
)
def j4b(spark, sf):
    """NaN and null are missing: half of one side, all but one row of the other, and a feature that is NaN throughout one."""
    key, balance, nan = F.col("c_custkey"), F.col("c_acctbal").cast("double"), F.lit(float("nan"))
    customers = testbed.table(spark, sf, "customer")
    base = customers.select(
        F.when(key % 2 == 0, balance).otherwise(nan).alias("c_acctbal"), nan.alias("c_nothing"), balance.alias("c_one_sided")
    )
    target = customers.select(
        F.when(key == 1, balance).when(key % 3 == 0, nan).alias("c_acctbal"),
        F.lit(None).cast("double").alias("c_nothing"),
        nan.alias("c_one_sided"),
    )
    return drift.feature_psi(base, target, ["c_acctbal", "c_nothing", "c_one_sided"]).select("feature", "psi")


# --- Queries whose twins were interrupted so far, with twins whose steps are stored one by one ---


def stepwise(statement: str) -> str:
    """The same statement with every common table expression materialised."""
    return re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", statement)


def _again(name: str) -> None:
    query(f"{name}_stepwise", stepwise(SQL[name]))(QUERIES[name])


for _name in (
    "c5_beta_ratio",
    "c7_usage_velocity",
    "c8_usage_features",
    "g7_hard_labels",
    "g14_non_negative_forecast",
    "k2_prediction_table",
    "l4_prepared_predictions",
    "l6_decimal_overflow",
    "m3b_tiers_without_threshold",
):
    _again(_name)
