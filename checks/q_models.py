"""Splits, metrics, the risk queue, recourse, drift and outputs; fitted models at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import testbed
from checks.q_features import SNAPS, scratch, snapshots
from checks.registry import query
from checks.sql import ACTIVE, RAW, SCORED, SNAPSHOTS, with_
from checks.testbed import CUTOFFS
from foresight import contract
from foresight.functions.labels import feature_drift_label, run_drift_label
from foresight.functions.numbers import round_half_even
from foresight.models.churn import FittedChurnModel, margin
from foresight.models.sales import SalesModel
from foresight.models.saved import fitted_churn
from foresight.operators import drift, metrics, recourse
from foresight.operators.outputs import prediction_table, run_notes, with_customer_id
from foresight.operators.split import split_by_position, temporal_split
from foresight.plans.score import publish, run_scoring_job, score_holdout
from foresight.session import bucketed, cut_lineage, ensure_checkpoint_dir, stored
from foresight.sources.store import write_snapshots

POPULATION = with_(RAW, ACTIVE, SCORED)
LABEL, P, FORECAST, ACTUAL = "churn_next_30d", "churn_probability", "predicted_sales", "future_mrr_30d"


# --- G: split ---

SIDES = "SELECT {side} AS side, cutoff_date::VARCHAR AS cutoff_date, count(*) AS row_count FROM scored GROUP BY 1, 2"


def _sides(train: DataFrame, holdout: DataFrame) -> DataFrame:
    both = train.withColumn("side", F.lit("train")).unionByName(
        holdout.withColumn("side", F.lit("holdout"))
    )
    return both.groupBy("side", "cutoff_date").agg(F.count("*").alias("row_count"))


@query(
    "g1_temporal_split",
    POPULATION + SIDES.format(
        side="CASE WHEN cutoff_date IN (SELECT DISTINCT cutoff_date FROM scored ORDER BY 1 LIMIT 16)"
        " THEN 'train' ELSE 'holdout' END"
    ),
)
def g1(spark, sf):
    return _sides(*temporal_split(testbed.scored(spark, sf)))


@query(
    "g2_split_by_date",
    POPULATION + SIDES.format(side="CASE WHEN cutoff_date < DATE '1998-12-15' THEN 'train' ELSE 'holdout' END"),
)
def g2(spark, sf):
    return _sides(*temporal_split(testbed.scored(spark, sf), split_date="1998-12-15"))


@query(
    "g3_split_by_position",
    POPULATION + "SELECT subscription_id, CASE WHEN row_number() OVER (ORDER BY subscription_id)"
    " <= floor(count(*) OVER () * (1.0::DOUBLE - 0.2::DOUBLE)) THEN 'train' ELSE 'holdout' END AS side"
    " FROM scored WHERE cutoff_date = DATE '1999-09-30'",
)
def g3(spark, sf):
    september = testbed.scored(spark, sf).filter("cutoff_date = DATE '1999-09-30'")
    train, rest = temporal_split(september, order_cols=["subscription_id"])
    return train.select("subscription_id", F.lit("train").alias("side")).unionByName(
        rest.select("subscription_id", F.lit("holdout").alias("side"))
    )


@query(
    "g3b_split_without_cutoff",
    "SELECT CASE WHEN rn <= floor(n * (1.0::DOUBLE - 0.2::DOUBLE)) THEN 'train' ELSE 'holdout' END AS side,"
    " count(*) AS row_count, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey,"
    " row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) GROUP BY 1",
)
def g3b(spark, sf):
    orders = testbed.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    sides = split_by_position(orders, ["o_orderdate", "o_orderkey"], at_least=0)
    summaries = [
        side.agg(
            F.lit(name).alias("side"),
            F.count("*").alias("row_count"),
            F.min("o_orderkey").alias("first_key"),
            F.max("o_orderkey").alias("last_key"),
        )
        for name, side in zip(("train", "holdout"), sides, strict=True)
    ]
    return summaries[0].unionByName(summaries[1])


# --- G: metrics over closed-form scores ---


@query(
    "g7_hard_labels",
    POPULATION + "SELECT subscription_id, cutoff_date::VARCHAR AS cutoff_date,"
    " (churn_probability >= 0.5)::INT AS churn_label FROM holdout",
)
def g7(spark, sf):
    label = metrics.hard_label(F.col(P)).alias("churn_label")
    return testbed.holdout(spark, sf).select("subscription_id", "cutoff_date", label)


@query(
    "g8_risk_threshold",
    POPULATION + "SELECT round(quantile_cont(churn_probability, 0.9), 9) AS risk_threshold"
    " FROM scored WHERE cutoff_date < DATE '1999-05-31'",
)
def g8(spark, sf):
    train, _ = temporal_split(testbed.scored(spark, sf))
    return metrics.risk_threshold(train, P).select(F.round("risk_threshold", 9).alias("risk_threshold"))


@query(
    "g9_roc_auc",
    POPULATION + "SELECT round((sum(pos * (neg_below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)))::DOUBLE, 9)"
    " AS churn_auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY churn_probability ROWS BETWEEN UNBOUNDED"
    " PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM (SELECT churn_probability,"
    " count(*) FILTER (churn_next_30d = 1) AS pos, count(*) FILTER (churn_next_30d = 0) AS neg"
    " FROM holdout GROUP BY 1))",
)
def g9(spark, sf):
    auc = metrics.roc_auc(testbed.holdout(spark, sf), LABEL, P)
    return spark.range(1).select(F.round(F.lit(auc), 9).alias("churn_auc"))


CONFUSION = (
    "SELECT count(*) FILTER (churn_next_30d = 0 AND NOT called) AS tn,"
    " count(*) FILTER (churn_next_30d = 0 AND called) AS fp,"
    " count(*) FILTER (churn_next_30d = 1 AND NOT called) AS fn,"
    " count(*) FILTER (churn_next_30d = 1 AND called) AS tp, count(*) AS sample_count,"
    " avg((churn_probability - churn_next_30d) * (churn_probability - churn_next_30d)) AS brier"
    " FROM (SELECT *, churn_probability >= 0.5 AS called FROM holdout)"
)


@query(
    "g10_precision_recall_f1",
    POPULATION + "SELECT round(tp / (tp + fp)::DOUBLE, 12) AS precision, round(tp / (tp + fn)::DOUBLE, 12) AS recall,"
    f" round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 12) AS f1 FROM ({CONFUSION})",
)
def g10(spark, sf):
    row = metrics.classification_metrics(testbed.holdout(spark, sf), LABEL, P)
    return row.select(*[F.round(c, 12).alias(c) for c in ("precision", "recall", "f1")])


@query("g11_brier_score", POPULATION + f"SELECT round(brier, 9) AS brier_score FROM ({CONFUSION})")
def g11(spark, sf):
    row = metrics.classification_metrics(testbed.holdout(spark, sf), LABEL, P)
    return row.select(F.round("brier_score", 9).alias("brier_score"))


@query("g12_confusion_matrix", POPULATION + f"SELECT tn, fp, fn, tp, sample_count FROM ({CONFUSION})")
def g12(spark, sf):
    row = metrics.classification_metrics(testbed.holdout(spark, sf), LABEL, P)
    return row.select("tn", "fp", "fn", "tp", "sample_count")


@query(
    "g14_non_negative_forecast",
    POPULATION + "SELECT subscription_id, cutoff_date::VARCHAR AS cutoff_date,"
    " greatest(0.0::DOUBLE, raw_forecast) AS predicted_sales FROM holdout",
)
def g14(spark, sf):
    rows = testbed.holdout(spark, sf)
    return rows.select("subscription_id", "cutoff_date", F.greatest(F.lit(0.0), "raw_forecast").alias(FORECAST))


ERRORS = "(SELECT *, abs(future_mrr_30d - predicted_sales) AS e FROM holdout)"


def _regression(spark, sf, *columns):
    row = metrics.regression_metrics(testbed.holdout(spark, sf), ACTUAL, FORECAST)
    return row.select(*[F.round(c, 6).alias(c) for c in columns])


@query(
    "g15_rmse_mae",
    POPULATION + f"SELECT round(sqrt(avg(e * e)), 6) AS sales_rmse, round(avg(e), 6) AS sales_mae FROM {ERRORS}",
)
def g15(spark, sf):
    return _regression(spark, sf, "sales_rmse", "sales_mae")


@query(
    "g16_mape_positive_actuals",
    POPULATION + f"SELECT round(avg(e / future_mrr_30d) FILTER (future_mrr_30d > 0), 6) AS sales_mape FROM {ERRORS}",
)
def g16(spark, sf):
    return _regression(spark, sf, "sales_mape")


@query(
    "g17_wmape",
    POPULATION + f"SELECT round(sum(e) / sum(abs(future_mrr_30d)), 6) AS sales_wmape FROM {ERRORS}",
)
def g17(spark, sf):
    return _regression(spark, sf, "sales_wmape")


@query(
    "g18_prediction_intervals",
    POPULATION + ", s AS (SELECT round(stddev_samp(future_mrr_30d - predicted_sales), 4) AS sigma FROM holdout)"
    " SELECT subscription_id, cutoff_date::VARCHAR AS cutoff_date, sigma,"
    " round_even(greatest(0.0::DOUBLE, predicted_sales - 1.96::DOUBLE * sigma) * 100, 0) / 100 AS sales_lower_bound,"
    " round_even((predicted_sales + 1.96::DOUBLE * sigma) * 100, 0) / 100 AS sales_upper_bound FROM holdout, s",
)
def g18(spark, sf):
    rows = testbed.holdout(spark, sf)
    # Four digits of sigma keep the two engines' last bits apart from the cents compared here.
    sigma = round(metrics.residual_sigma(rows, ACTUAL, FORECAST).first()[0], 4)
    return metrics.prediction_intervals(rows, FORECAST, sigma).select(
        "subscription_id",
        "cutoff_date",
        F.lit(sigma).alias("sigma"),
        "sales_lower_bound",
        "sales_upper_bound",
    )


# --- H: risk queue ---

QUEUE = (
    "SELECT *, captured_churners / total_churners::DOUBLE AS risk_queue_recall,"
    " captured_churners / risk_queue_count::DOUBLE AS risk_queue_precision,"
    " total_churners / sample_count::DOUBLE AS base_churn_rate FROM (SELECT"
    " count(*) FILTER (churn_probability >= 0.85) AS risk_queue_count,"
    " count(*) FILTER (churn_next_30d = 1) AS total_churners,"
    " count(*) FILTER (churn_next_30d = 1 AND churn_probability >= 0.85) AS captured_churners,"
    " count(*) AS sample_count FROM holdout)"
)


def _queue(spark, sf):
    return metrics.queue_statistics(testbed.holdout(spark, sf), LABEL, P, 0.85)


@query("h1_queue_count", POPULATION + f"SELECT risk_queue_count, sample_count FROM ({QUEUE})")
def h1(spark, sf):
    return _queue(spark, sf).select("risk_queue_count", "sample_count")


@query(
    "h2_queue_recall_precision",
    POPULATION + f"SELECT captured_churners, total_churners, risk_queue_recall, risk_queue_precision FROM ({QUEUE})",
)
def h2(spark, sf):
    return _queue(spark, sf).select(
        "captured_churners", "total_churners", "risk_queue_recall", "risk_queue_precision"
    )


@query(
    "h3_queue_lift",
    POPULATION + f"SELECT base_churn_rate, risk_queue_precision / base_churn_rate AS risk_queue_lift FROM ({QUEUE})",
)
def h3(spark, sf):
    return _queue(spark, sf).select("base_churn_rate", "risk_queue_lift")


# --- I: recourse with a closed-form scorer on the mutable columns ---

# Factors are multiples of 1/25, so a four-digit base never lands on a rounding tie.
SCORE = (
    "((subscription_id * 7919) % 10000) / 10000.0D"
    " * CASE WHEN lower(billing_frequency) = 'annual' THEN 0.8D ELSE 1.0D END"
    " * CASE WHEN auto_renew_flag = 1 THEN 0.84D ELSE 1.0D END"
    " * CASE lower(plan_tier) WHEN 'enterprise' THEN 0.72D WHEN 'professional' THEN 0.88D ELSE 1.0D END"
    " * CASE WHEN is_trial = 1 THEN 1.0D ELSE 0.96D END"
)
THRESHOLD = 0.3


def closed_form(df: DataFrame) -> DataFrame:
    return df.withColumn(P, F.expr(SCORE))


def _contracts(spark, sf) -> DataFrame:
    from foresight.operators.spine import active_subscriptions, subscription_features

    last = active_subscriptions(testbed.subscriptions(spark, sf), CUTOFFS[-5:])
    return closed_form(subscription_features(last))


def _score_sql(billing: str, auto: str, tier: str, trial: str) -> str:
    return (
        "((subscription_id * 7919) % 10000)::DOUBLE / 10000.0::DOUBLE"
        f" * CASE WHEN lower({billing}) = 'annual' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"
        f" * CASE WHEN {auto} = 1 THEN 0.84::DOUBLE ELSE 1.0::DOUBLE END"
        f" * CASE lower({tier}) WHEN 'enterprise' THEN 0.72::DOUBLE WHEN 'professional' THEN 0.88::DOUBLE"
        " ELSE 1.0::DOUBLE END"
        f" * CASE WHEN {trial} = 1 THEN 1.0::DOUBLE ELSE 0.96::DOUBLE END"
    )


def _offer(ordinal, action, test, billing="NULL", auto="NULL", tier="NULL", trial="NULL") -> str:
    return (
        f"SELECT subscription_id, cutoff_date, {ordinal} AS ordinal, '{action}' AS action, {billing}::VARCHAR AS b,"
        f" {auto}::INT AS a, {tier}::VARCHAR AS t, {trial}::INT AS x FROM contracts WHERE {test}"
    )


_NOT_ANNUAL, _NO_RENEW = "lower(billing_frequency) <> 'annual'", "auto_renew_flag = 0"
_ENTRY = "lower(plan_tier) IN ('starter', 'free', 'basic')"
_MIDDLE = "lower(plan_tier) IN ('professional', 'pro', 'growth')"
_OFFERS = " UNION ALL ".join(
    [
        _offer(1, recourse.ANNUAL, _NOT_ANNUAL, billing="'annual'"),
        _offer(2, recourse.AUTO_RENEW, _NO_RENEW, auto=1),
        _offer(3, recourse.LOCK_IN, f"{_NOT_ANNUAL} OR {_NO_RENEW}", billing="'annual'", auto=1),
        _offer(4, recourse.PROFESSIONAL, _ENTRY, auto=1, tier="'professional'"),
        _offer(4, recourse.ENTERPRISE, _MIDDLE, billing="'annual'", auto=1, tier="'enterprise'"),
        _offer(5, recourse.END_TRIAL, "is_trial = 1", billing="'annual'", auto=1, trial=0),
        _offer(
            6,
            recourse.OUTREACH,
            f"NOT ({_NOT_ANNUAL} OR {_NO_RENEW} OR {_ENTRY} OR {_MIDDLE} OR is_trial = 1)",
            auto=1,
        ),
    ]
)
RECOURSE = with_(RAW, ACTIVE) + f""",
contracts AS (
  SELECT *, {_score_sql('billing_frequency', 'auto_renew_flag', 'plan_tier', 'is_trial')} AS p FROM (
    SELECT subscription_id, cutoff_date, plan_tier, billing_frequency, coalesce(is_trial, false)::INT AS is_trial,
      coalesce(auto_renew_flag, false)::INT AS auto_renew_flag FROM active WHERE cutoff_date >= DATE '1999-05-31')),
offers AS ({_OFFERS}),
changed AS (
  SELECT c.subscription_id, c.cutoff_date, p, ordinal, action, coalesce(b, billing_frequency) AS billing_frequency,
    coalesce(a, auto_renew_flag) AS auto_renew_flag, coalesce(t, plan_tier) AS plan_tier,
    coalesce(x, is_trial) AS is_trial
  FROM contracts c JOIN offers o ON c.subscription_id = o.subscription_id AND c.cutoff_date = o.cutoff_date),
rescored AS (
  SELECT *, {_score_sql('billing_frequency', 'auto_renew_flag', 'plan_tier', 'is_trial')} AS simulated FROM changed),
best AS (
  SELECT *, row_number() OVER (PARTITION BY subscription_id, cutoff_date ORDER BY simulated, ordinal) AS place
  FROM rescored WHERE p > {THRESHOLD}::DOUBLE),
advice AS (
  SELECT c.subscription_id, c.cutoff_date, c.p AS churn_probability,
    CASE WHEN c.p <= {THRESHOLD}::DOUBLE THEN '{recourse.LOW_RISK}'
      WHEN simulated < c.p THEN action || ' (Simulated Risk: ' || printf('%.2f%%', c.p * 100) || ' -> '
        || printf('%.2f%%', simulated * 100) || ')'
      ELSE '{recourse.NO_ACTION}' END AS prescriptive_action,
    round_even((CASE WHEN c.p > {THRESHOLD}::DOUBLE AND simulated < c.p THEN simulated ELSE c.p END) * 10000, 0)
      / 10000 AS prescribed_risk_drop
  FROM contracts c LEFT JOIN best b ON c.subscription_id = b.subscription_id AND c.cutoff_date = b.cutoff_date
    AND place = 1)
"""


@query(
    "i2_candidate_actions",
    RECOURSE + "SELECT subscription_id, cutoff_date, ordinal, action FROM offers",
)
def i2(spark, sf):
    exploded = recourse.explode_candidates(_contracts(spark, sf))
    return exploded.select("subscription_id", "cutoff_date", "candidate.ordinal", "candidate.action")


@query(
    "i3_counterfactual_rows",
    RECOURSE + "SELECT subscription_id, cutoff_date, ordinal, billing_frequency, auto_renew_flag, plan_tier, is_trial"
    " FROM changed",
)
def i3(spark, sf):
    rows = recourse.apply_candidate(recourse.explode_candidates(_contracts(spark, sf)))
    return rows.select(
        "subscription_id", "cutoff_date", "candidate.ordinal", *contract.MUTABLE
    )


@query(
    "i4_immutable_check",
    SNAPS + "SELECT cutoff_date, 'industry' AS \"column\", count(*) AS row_count FROM snapshots"
    " WHERE subscription_id % 101 = 0 AND industry IS NOT NULL GROUP BY 1",
)
def i4(spark, sf):
    """Candidates change no immutable column; a tampered industry is found in every row that has one."""
    keys = ["subscription_id", "cutoff_date"]
    rows = bucketed(snapshots(spark, sf), "account_id")  # four readers, which meet in place
    changed = recourse.apply_candidate(recourse.explode_candidates(rows))
    industry = F.when(F.col("subscription_id") % 101 == 0, F.lower("industry")).otherwise(F.col("industry"))
    tampered = rows.withColumn("industry", industry)
    found = recourse.immutable_violations(rows, changed, keys, near="account_id").union(
        recourse.immutable_violations(rows, tampered, keys, near="account_id")
    )
    return found.groupBy("cutoff_date", "column").agg(F.count("*").alias("row_count"))


@query(
    "i5_rescored_candidates",
    RECOURSE + "SELECT subscription_id, cutoff_date, ordinal, p AS current, simulated FROM rescored"
    f" WHERE p > {THRESHOLD}::DOUBLE",
)
def i5(spark, sf):
    queued = _contracts(spark, sf).filter(F.col(P) > THRESHOLD)
    scored = recourse.score_candidates(queued, closed_form, P)
    return scored.select("subscription_id", "cutoff_date", "candidate.ordinal", "current", "simulated")


def _advice(spark, sf):
    return recourse.recommend(
        _contracts(spark, sf), closed_form, THRESHOLD, ["subscription_id", "cutoff_date"], P
    )


@query(
    "i6_best_action",
    RECOURSE + "SELECT subscription_id, cutoff_date, prescribed_risk_drop FROM advice"
    f" WHERE churn_probability > {THRESHOLD}::DOUBLE",
)
def i6(spark, sf):
    queued = _advice(spark, sf).filter(F.col(P) > THRESHOLD)
    return queued.select("subscription_id", "cutoff_date", "prescribed_risk_drop")


@query(
    "i7_gated_rows",
    RECOURSE + "SELECT subscription_id, cutoff_date, prescriptive_action, prescribed_risk_drop FROM advice"
    f" WHERE churn_probability <= {THRESHOLD}::DOUBLE",
)
def i7(spark, sf):
    calm = _advice(spark, sf).filter(F.col(P) <= THRESHOLD)
    return calm.select("subscription_id", "cutoff_date", "prescriptive_action", "prescribed_risk_drop")


@query(
    "i8_action_texts",
    RECOURSE + "SELECT prescriptive_action, count(*) AS customers FROM advice GROUP BY 1",
)
def i8(spark, sf):
    return _advice(spark, sf).groupBy("prescriptive_action").agg(F.count("*").alias("customers"))


@query("i9_recourse", RECOURSE + "SELECT * FROM advice")
def i9(spark, sf):
    return _advice(spark, sf)


# --- J: drift of snapshot features, train months against holdout months ---

_NUMERIC = contract.NUMERIC + contract.BOOLEAN
_SIDES = "(cutoff_date >= '1999-05-31') AS is_target"
PSI = with_(*SNAPSHOTS) + f""",
long AS (
  UNPIVOT (SELECT {_SIDES}, {', '.join(f'{c}::DOUBLE AS {c}' for c in _NUMERIC)} FROM snapshots)
  ON {', '.join(_NUMERIC)} INTO NAME feature VALUE value),
quantiles AS (
  SELECT feature, min(value) AS low, max(value) AS high,
    list_sort(list_distinct(quantile_cont(value, [{', '.join(str(i / 10) for i in range(11))}]))) AS q
  FROM long WHERE NOT is_target GROUP BY 1),
edges AS (
  SELECT feature, CASE WHEN len(q) < 2 THEN list_transform(range(1, 10), lambda i:
    (low - 0.001) + ((high + 0.001) - (low - 0.001)) / 10 * i) ELSE q[2:-2] END AS inner_edges FROM quantiles),
bins AS (
  SELECT feature, len(inner_edges) + 1 AS k, unnest(range(len(inner_edges) + 1)) AS bin FROM edges),
hits AS (
  SELECT feature, len(list_filter(inner_edges, lambda e: value >= e)) AS bin,
    count(*) FILTER (NOT is_target) AS nb, count(*) FILTER (is_target) AS nt
  FROM long JOIN edges USING (feature) GROUP BY 1, 2),
numeric_bins AS (
  SELECT b.feature, k, coalesce(nb, 0) AS nb, coalesce(nt, 0) AS nt
  FROM bins b LEFT JOIN hits h ON b.feature = h.feature AND b.bin = h.bin),
category_long AS (
  UNPIVOT (SELECT {_SIDES}, {', '.join(contract.CATEGORICAL)} FROM snapshots)
  ON {', '.join(contract.CATEGORICAL)} INTO NAME feature VALUE value),
category_bins AS (
  SELECT feature, count(*) OVER (PARTITION BY feature) AS k, nb, nt FROM (
    SELECT feature, value, count(*) FILTER (NOT is_target) AS nb, count(*) FILTER (is_target) AS nt
    FROM category_long GROUP BY 1, 2)),
shares AS (
  SELECT feature, (nb + 1e-4) / (sum(nb) OVER f + k * 1e-4) AS p, (nt + 1e-4) / (sum(nt) OVER f + k * 1e-4) AS q
  FROM (SELECT * FROM numeric_bins UNION ALL SELECT * FROM category_bins) WINDOW f AS (PARTITION BY feature)),
psi AS (
  SELECT feature, round(greatest(0, sum((q - p) * ln(q / p))), 4) AS psi FROM shares GROUP BY 1),
labelled AS (
  SELECT feature, psi, CASE WHEN feature IN ('account_age_days', 'active_tenure_days') AND psi > 0.20
      THEN 'Expected Calendar Aging' WHEN psi < 0.10 THEN 'Stable' WHEN psi <= 0.20 THEN 'Moderate Shift'
      ELSE 'Critical Drift' END AS label FROM psi)
"""


def _populations(spark, sf) -> tuple[DataFrame, DataFrame]:
    """One build, stored once; each reader of a side takes only its columns."""
    data = stored(snapshots(spark, sf))
    return temporal_split(data, split_date=testbed.HOLDOUT_START)


def _by_feature(spark, sf):
    return drift.feature_psi(*_populations(spark, sf))


@query(
    "j1_decile_edges",
    PSI + "SELECT feature, i, round(inner_edges[i], 6) AS edge FROM (SELECT feature, inner_edges,"
    " unnest(range(1, len(inner_edges) + 1)) AS i FROM edges)",
)
def j1(spark, sf):
    train, _ = _populations(spark, sf)
    edges = drift.decile_edges(train, _NUMERIC)
    return edges.select("feature", F.posexplode("inner").alias("i", "edge")).select(
        "feature", (F.col("i") + 1).cast("bigint").alias("i"), F.round("edge", 6).alias("edge")
    )


@query(
    "j2_constant_baseline",
    "SELECT n_name AS country, i, round((v - 0.001) + 0.002 / 10 * i, 6) AS edge FROM"
    " (SELECT n_name, n_nationkey::DOUBLE AS v FROM nation), (SELECT unnest(range(1, 10)) AS i)",
)
def j2(spark, sf):
    """Each nation's customers share one nation key: a constant feature per nation."""
    customers = testbed.table(spark, sf, "customer").select("c_nationkey").distinct()
    names = testbed.table(spark, sf, "nation").select("n_name", "n_nationkey")
    constant = customers.join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    wide = constant.groupBy().pivot("n_name").agg(F.first("c_nationkey"))
    edges = drift.decile_edges(wide, wide.columns)
    return edges.select(F.col("feature").alias("country"), F.posexplode("inner").alias("i", "edge")).select(
        "country", (F.col("i") + 1).cast("bigint").alias("i"), F.round("edge", 6).alias("edge")
    )


@query(
    "j3_categorical_psi",
    PSI + f"SELECT feature, psi FROM psi WHERE feature IN ({', '.join(repr(c) for c in contract.CATEGORICAL)})",
)
def j3(spark, sf):
    scores = drift.categorical_psi(*_populations(spark, sf), contract.CATEGORICAL)
    return scores.select("feature", round_half_even(F.col("psi"), 4).alias("psi"))


@query(
    "j4_empty_side",
    "SELECT 'c_acctbal' AS feature, 0.0::DOUBLE AS psi, 'Stable' AS label FROM customer LIMIT 1",
)
def j4(spark, sf):
    balances = testbed.table(spark, sf, "customer").select("c_acctbal")
    nothing = balances.withColumn("c_acctbal", F.lit(None).cast("double"))
    return drift.feature_psi(balances, nothing, ["c_acctbal"])


@query(
    "j5_numeric_psi",
    PSI + f"SELECT feature, psi FROM psi WHERE feature IN ({', '.join(repr(c) for c in _NUMERIC)})",
)
def j5(spark, sf):
    scores = drift.numeric_psi(*_populations(spark, sf), _NUMERIC)
    return scores.select("feature", round_half_even(F.col("psi"), 4).alias("psi"))


@query("j6_feature_psi", PSI + "SELECT feature, psi FROM psi")
def j6(spark, sf):
    return _by_feature(spark, sf).select("feature", "psi")


@query(
    "j7_aggregate_psi",
    PSI + "SELECT psi_score, psi_score > 0.20 AS drift_flag FROM (SELECT round(avg(psi), 4) AS psi_score FROM psi)",
)
def j7(spark, sf):
    return drift.aggregate_psi(_by_feature(spark, sf)).select("psi_score", "drift_flag")


@query(
    "j8_run_drift_label",
    PSI + "SELECT feature, CASE WHEN psi < 0.10 THEN 'Stable (No Shift)' WHEN psi <= 0.20"
    " THEN 'Moderate Shift (Monitor)' ELSE 'Critical Drift (Action Required)' END AS label FROM psi",
)
def j8(spark, sf):
    return _by_feature(spark, sf).select("feature", run_drift_label(F.col("psi")).alias("label"))


@query("j9_feature_drift_label", PSI + "SELECT feature, label FROM labelled")
def j9(spark, sf):
    scores = _by_feature(spark, sf).select("feature", "psi")
    return scores.select("feature", feature_drift_label(F.col("feature"), F.col("psi")).alias("label"))


@query(
    "j10_calendar_aging",
    PSI + "SELECT feature, psi FROM labelled WHERE label = 'Expected Calendar Aging'",
)
def j10(spark, sf):
    return drift.calendar_aging_features(_by_feature(spark, sf))


# --- K: outputs ---


@query(
    "k2_prediction_table",
    POPULATION + "SELECT account_id::VARCHAR AS customer_id, churn_next_30d AS actual_churn, churn_probability,"
    " round_even(future_mrr_30d * 100, 0) / 100 AS actual_sales,"
    " round_even(predicted_sales * 100, 0) / 100 AS predicted_sales,"
    " round_even(greatest(0.0::DOUBLE, predicted_sales - 1.96::DOUBLE * 500.0::DOUBLE) * 100, 0) / 100"
    " AS sales_lower_bound,"
    " round_even((predicted_sales + 1.96::DOUBLE * 500.0::DOUBLE) * 100, 0) / 100 AS sales_upper_bound,"
    " 'none' AS prescriptive_action, churn_probability AS prescribed_risk_drop, subscription_id,"
    " cutoff_date::VARCHAR AS cutoff_date FROM holdout",
)
def k2(spark, sf):
    rows = with_customer_id(testbed.holdout(spark, sf))
    bounded = metrics.prediction_intervals(rows, FORECAST, 500.0)
    advised = bounded.withColumn("prescriptive_action", F.lit("none")).withColumn("prescribed_risk_drop", F.col(P))
    return prediction_table(advised, ACTUAL)


@query(
    "k4_run_notes",
    POPULATION + "SELECT 'Dual model pipeline: test models. Residual sigma=1234.57. Drift status: Moderate Shift"
    " (Monitor). Top-10% risk threshold=0.850000 captured ' || captured_churners || '/' || total_churners ||"
    " ' holdout churners (lift: ' || printf('%.2f', risk_queue_precision / base_churn_rate) || 'x). Feature-level"
    " calendar aging observed in account_age_days, active_tenure_days; treated as expected temporal drift.' AS notes"
    f" FROM ({QUEUE})",
)
def k4(spark, sf):
    aging = F.array(*[F.lit(f) for f in contract.CALENDAR_AGING])
    notes = run_notes(
        F.lit(1234.5678),
        F.lit(0.15),
        F.lit(0.85),
        F.col("captured_churners"),
        F.col("total_churners"),
        F.col("risk_queue_lift"),
        aging,
        models="test models",
    )
    return _queue(spark, sf).select(notes.alias("notes"))


# --- Fitted models: no SQL twin; the library's defaults throughout. ---


def _split(spark, sf) -> tuple[DataFrame, DataFrame]:
    return temporal_split(cut_lineage(snapshots(spark, sf)))


def _churn(spark, sf) -> tuple[FittedChurnModel, DataFrame]:
    """The churn model and its holdout; a model of the same rows and settings is stored state, not fitted anew."""
    train, holdout = _split(spark, sf)
    ensure_checkpoint_dir(spark)
    return fitted_churn(train, f"{spark.sparkContext.getCheckpointDir()}/churn-models"), holdout


@query("g4_tree_margins")
def g4(spark, sf):
    """Uncalibrated margins of each fold's trees on the holdout."""
    churn, holdout = _churn(spark, sf)
    rows = churn.preprocessor.transform(holdout)
    for fold, member in enumerate(churn.members):
        rows = margin(member.trees, rows, f"margin_{fold}")
    return rows.select("subscription_id", "cutoff_date", *[f"margin_{i}" for i in range(len(churn.members))])


@query("g5_calibrated_members")
def g5(spark, sf):
    members = [
        (i, m.trees.getNumTrees, float(m.sigmoid[0]), float(m.sigmoid[1]))
        for i, m in enumerate(_churn(spark, sf)[0].members)
    ]
    return spark.createDataFrame(members, "fold int, trees int, slope double, intercept double")


@query("g6_churn_scores")
def g6(spark, sf):
    churn, holdout = _churn(spark, sf)
    scored = churn.transform(holdout)
    return scored.select("subscription_id", "cutoff_date", P)


#: Every category that the tables may hold; one that is absent has an all-zero column and weight zero.
CATEGORIES = {
    "industry": "SELECT DISTINCT c_mktsegment FROM customer",
    "country": "SELECT DISTINCT n_name FROM nation",
    "referral_source": "SELECT unnest(['organic', 'partner', 'ads', 'direct'])",
    "plan_tier": "SELECT unnest(['Enterprise', 'professional', 'starter', 'Basic', 'growth'])",
    "billing_frequency": "SELECT unnest(['annual', 'monthly'])",
}
_NUMBERS = [c for c in contract.SALES_NUMERIC]
_FLAGS = list(contract.BOOLEAN)
_FIRST_LABEL = 2 + len(_NUMBERS) + len(_FLAGS)


def _long(side: str) -> str:
    """(row, i, v) of the model matrix without its zeros: 1 is the intercept, then numbers, flags, labels."""
    scaled = [
        f"SELECT id, {i + 2} AS i, ({c} - (SELECT m FROM stats WHERE f = {i})) / (SELECT s FROM stats WHERE f = {i}) AS v FROM {side}"
        for i, c in enumerate(_NUMBERS)
    ]
    flags = [f"SELECT id, {i + 2 + len(_NUMBERS)}, {c}::DOUBLE FROM {side}" for i, c in enumerate(_FLAGS)]
    labels = [
        f"SELECT id, l.i, 1.0::DOUBLE FROM {side} JOIN labels l ON l.name = '{c}' AND l.label = {c}" for c in CATEGORIES
    ]
    return f"SELECT id, 1 AS i, 1.0::DOUBLE AS v FROM {side} UNION ALL " + " UNION ALL ".join([*scaled, *flags, *labels])


RIDGE = (
    SNAPS.rstrip()
    + f""",
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY subscription_id, cutoff_date) AS id FROM snapshots),
last_train AS (SELECT max(cutoff_date) AS d FROM (SELECT DISTINCT cutoff_date FROM numbered ORDER BY 1 LIMIT {{cut}})),
train AS MATERIALIZED (SELECT * FROM numbered WHERE cutoff_date <= (SELECT d FROM last_train)),
holdout AS MATERIALIZED (SELECT * FROM numbered WHERE cutoff_date > (SELECT d FROM last_train)),
stats AS MATERIALIZED ({" UNION ALL ".join(
    f"SELECT {i} AS f, avg({c}) AS m, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s FROM train"
    for i, c in enumerate(_NUMBERS)
)}),
labels AS MATERIALIZED (SELECT name, label, {_FIRST_LABEL} - 1 + row_number() OVER (ORDER BY name, label) AS i FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS name, label FROM ({q}) t(label)" for c, q in CATEGORIES.items())})),
size AS (SELECT max(i) AS d FROM labels),
long AS MATERIALIZED (SELECT * FROM ({_long("train")}) WHERE v <> 0),
gram AS MATERIALIZED (
  SELECT a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i AND a.i > 1 THEN 1.0 ELSE 0.0 END AS v
  FROM long a JOIN long b ON b.id = a.id GROUP BY a.i, b.i
  UNION ALL
  SELECT l.i, (SELECT d FROM size) + 1, sum(l.v * t.future_mrr_30d) FROM long l JOIN train t ON t.id = l.id GROUP BY l.i),
grid AS (
  SELECT r.i, c.i AS j, coalesce(v, CASE WHEN r.i = c.i THEN 1.0 ELSE 0.0 END) AS v
  FROM (SELECT unnest(range(1, (SELECT d FROM size) + 1)) AS i) r
  CROSS JOIN (SELECT unnest(range(1, (SELECT d FROM size) + 2)) AS i) c LEFT JOIN gram g ON g.i = r.i AND g.j = c.i),
solved AS (
  SELECT 0 AS k, (SELECT list(r ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS r FROM grid GROUP BY i)) AS m
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE
      WHEN i = k + 1 THEN list_transform(r, lambda x: x / m[k + 1][k + 1])
      ELSE list_transform(r, lambda x, j: x - m[k + 1][j] * (r[k + 1] / m[k + 1][k + 1])) END)
  FROM solved WHERE k < len(m)),
weights AS MATERIALIZED (
  SELECT unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda r: r[len(m) + 1])) AS w
  FROM solved WHERE k = len(m)),
asked AS (SELECT * FROM ({_long("holdout")}) WHERE v <> 0)
"""
).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "g13_revenue_forecasts",
    RIDGE.format(cut=16)
    + "SELECT subscription_id, cutoff_date, round_even(greatest(0.0, forecast), 1) AS predicted_sales FROM ("
    " SELECT id, sum(v * w) AS forecast FROM asked JOIN weights USING (i) GROUP BY id) JOIN holdout USING (id)",
)
def g13(spark, sf):
    """Forecasts of the ridge model; the twin builds and solves the same normal equations."""
    train, holdout = _split(spark, sf)
    forecasts = SalesModel().fit(train, contract.SALES_TARGET).transform(holdout)
    return forecasts.select("subscription_id", "cutoff_date", round_half_even(F.col(FORECAST), 1).alias(FORECAST))


@query("k3_run_telemetry")
def k3(spark, sf):
    """The record, its auxiliary metrics spread over columns."""
    run = score_holdout(cut_lineage(snapshots(spark, sf)))
    aux = F.col("auxiliary_metrics")
    psi = F.transform(F.array_sort(F.map_entries(aux["psi_by_feature"])), lambda e: F.concat_ws("=", e["key"], e["value"]))
    extra = {f"aux_{k}": aux[k] for k in ("precision", "recall", "f1", "brier_score")}
    return run.telemetry.withColumns({**extra, "aux_psi": F.concat_ws(",", psi)}).drop("auxiliary_metrics")


@query("k6_scoring_job")
def k6(spark, sf):
    """The job from saved snapshots to exported files and the published run."""
    snapshot_path = write_snapshots(snapshots(spark, sf), scratch(spark))
    run = run_scoring_job(spark, snapshot_path, scratch(spark))
    published = scratch(spark)
    publish(spark, run, f"{published}/telemetry", f"{published}/predictions")
    return spark.read.parquet(f"{published}/predictions").drop("run_id")
