"""Sources, spine, usage, support, snapshots and preprocessing."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql, testbed
from checks.registry import query
from checks.sql import ACTIVE, RAW, SNAPSHOTS, SUPPORT, raw_ctes, usage_cte, with_
from checks.testbed import CUTOFFS
from foresight import contract
from foresight.functions.dates import month_end_frame, month_ends
from foresight.models.prep import churn_preprocessor, sales_preprocessor, scaling_statistics
from foresight.operators import spine, support, usage
from foresight.operators.leakage import leakage_report, replay_leaks
from foresight.operators.packing import pack_by_cutoff
from foresight.plans.build import append_cohorts, build_snapshots, run_snapshot_job
from foresight.session import ensure_checkpoint_dir, stored
from foresight.sources.raw import conform, load_raw, normalise_flags
from foresight.sources.store import read_snapshots, write_snapshots


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"


def raw_files(spark: SparkSession, sf_dir: str) -> str:
    """The four tables as CSV with headers, as the jobs read them."""
    folder = scratch(spark)
    for name, df in testbed.raw(spark, sf_dir).items():
        df.write.option("header", True).csv(f"{folder}/{name}.csv")
    return folder


def snapshots(spark: SparkSession, sf_dir: str, cutoffs=None, hot=None) -> DataFrame:
    raw = testbed.raw(spark, sf_dir)
    return build_snapshots(
        raw["accounts"],
        raw["subscriptions"],
        raw["feature_usage"],
        raw["support_tickets"],
        CUTOFFS if cutoffs is None else cutoffs,
        hot=hot,
    )


SPINE = with_(RAW, ACTIVE)
USAGE = with_(RAW, ACTIVE, usage_cte())
TICKETS = with_(RAW, ACTIVE, SUPPORT)
SNAPS = with_(*SNAPSHOTS)
SNAPSHOT_SQL = SNAPS + f"SELECT {', '.join(contract.SNAPSHOT_COLUMNS)} FROM snapshots"


# --- A: sources ---


@query(
    "a1_raw_tables",
    with_(RAW)
    + "SELECT 'accounts' AS name, count(*) AS row_count, count(DISTINCT account_id) AS keys FROM accounts"
    " UNION ALL SELECT 'subscriptions', count(*), count(DISTINCT subscription_id) FROM subscriptions"
    " UNION ALL SELECT 'feature_usage', count(*), count(DISTINCT subscription_id) FROM usage"
    " UNION ALL SELECT 'support_tickets', count(*), count(DISTINCT ticket_id) FROM tickets",
)
def a1(spark, sf):
    keys = dict(zip(contract.RAW_TABLES, ["account_id", "subscription_id", "subscription_id", "ticket_id"], strict=True))
    tables = load_raw(spark, raw_files(spark, sf), fmt="csv")
    counted = [
        df.agg(
            F.lit(name).alias("name"),
            F.count("*").alias("row_count"),
            F.count_distinct(keys[name]).alias("keys"),
        )
        for name, df in tables.items()
    ]
    return append_cohorts(*counted)


@query(
    "a2_parsed_dates",
    with_(RAW) + "SELECT ticket_id::VARCHAR AS ticket_id, submitted_at, closed_at FROM tickets",
)
def a2(spark, sf):
    raw = testbed.tickets(spark, sf)
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    return conform(text, "support_tickets").select("ticket_id", "submitted_at", "closed_at")


@query(
    "a3_normalised_flags",
    with_(RAW) + "SELECT subscription_id, coalesce(is_trial, false) AS is_trial,"
    " coalesce(auto_renew_flag, false) AS auto_renew_flag FROM subscriptions",
)
def a3(spark, sf):
    flags = normalise_flags(testbed.subscriptions(spark, sf), "subscriptions")
    return flags.select("subscription_id", "is_trial", "auto_renew_flag")


@query(
    "a3b_flags_missing_as_true",
    with_(RAW) + "SELECT subscription_id, coalesce(auto_renew_flag, true) AS auto_renew_flag FROM subscriptions",
)
def a3b(spark, sf):
    flags = normalise_flags(testbed.subscriptions(spark, sf), "subscriptions", null_flag=True)
    return flags.select("subscription_id", "auto_renew_flag")


@query(
    "a4_supplied_tables",
    with_(RAW) + "SELECT ticket_id, coalesce(escalation_flag, false) AS escalation_flag FROM tickets",
)
def a4(spark, sf):
    tables = load_raw(spark, sf, tables=testbed.raw(spark, sf))
    return tables["support_tickets"].select("ticket_id", "escalation_flag")


@query("a5_stored_snapshots", SNAPSHOT_SQL)
def a5(spark, sf):
    return read_snapshots(spark, write_snapshots(snapshots(spark, sf), scratch(spark)))


@query(
    "a7_snapshot_partitions",
    SNAPS + "SELECT cutoff_date, count(*) AS row_count FROM snapshots GROUP BY 1",
)
def a7(spark, sf):
    stored = read_snapshots(spark, write_snapshots(snapshots(spark, sf), scratch(spark)))
    return stored.groupBy("cutoff_date").agg(F.count("*").alias("row_count"))


# --- B: spine ---


@query("b1_month_end_cutoffs", with_(RAW) + "SELECT c.cutoff_date, count(*) AS started"
       " FROM cutoffs c JOIN subscriptions s ON last_day(s.start_date) = c.cutoff_date::DATE GROUP BY 1")
def b1(spark, sf):
    calendar = month_end_frame(spark, testbed.START, testbed.END)
    month = F.last_day("start_date").cast("timestamp_ntz")
    started = testbed.subscriptions(spark, sf).groupBy(month.alias("cutoff_date")).agg(F.count("*").alias("started"))
    return started.join(F.broadcast(calendar), "cutoff_date")  # the calendar has 21 rows


@query("b2_active_subscriptions", SPINE + "SELECT subscription_id, account_id, cutoff_date, start_date, end_date FROM active")
def b2(spark, sf):
    active = spine.active_subscriptions(testbed.subscriptions(spark, sf), CUTOFFS)
    return active.select("subscription_id", "account_id", "cutoff_date", "start_date", "end_date")


def _targets(spark, sf):
    return spine.with_targets(spine.active_subscriptions(testbed.subscriptions(spark, sf), CUTOFFS))


@query("b3_churn_target", SPINE + "SELECT subscription_id, cutoff_date, churn_next_30d FROM targets")
def b3(spark, sf):
    return _targets(spark, sf).select("subscription_id", "cutoff_date", "churn_next_30d")


@query("b4_forward_mrr_target", SPINE + "SELECT subscription_id, cutoff_date, future_mrr_30d FROM targets")
def b4(spark, sf):
    return _targets(spark, sf).select("subscription_id", "cutoff_date", "future_mrr_30d")


@query("b5_fallback_target", SPINE + "SELECT subscription_id, cutoff_date, future_mrr_30d FROM targets")
def b5(spark, sf):
    df, target = spine.resolve_sales_target(_targets(spark, sf).drop("future_mrr_30d"))
    return df.select("subscription_id", "cutoff_date", F.col(target).alias("future_mrr_30d"))


@query(
    "b6_subscription_features",
    SPINE + "SELECT subscription_id, account_id, cutoff_date, plan_tier, seats, mrr_amount, arr_amount,"
    " coalesce(is_trial, false)::INT AS is_trial, billing_frequency,"
    " coalesce(auto_renew_flag, false)::INT AS auto_renew_flag,"
    " datediff('day', start_date, cutoff_date)::INT AS active_tenure_days FROM active",
)
def b6(spark, sf):
    return spine.subscription_features(spine.active_subscriptions(testbed.subscriptions(spark, sf), CUTOFFS))


@query(
    "b7_account_features",
    SPINE + "SELECT subscription_id, s.cutoff_date, industry, country, referral_source,"
    f" CASE WHEN signup_date IS NOT NULL THEN {sql.ACCOUNT_AGE} END AS account_age_days"
    " FROM active s LEFT JOIN accounts USING (account_id)",
)
def b7(spark, sf):
    return spine.account_features(testbed.subscriptions(spark, sf), testbed.accounts(spark, sf), CUTOFFS)


@query(
    "b8_cohort_sizes",
    "WITH cutoffs AS (SELECT last_day(m)::TIMESTAMP AS cutoff_date FROM (SELECT unnest(generate_series("
    "DATE '1994-10-01', DATE '1995-03-31', INTERVAL 1 MONTH)) AS m)) "
    "SELECT cutoff_date, count(*) AS active FROM orders JOIN cutoffs ON o_orderdate <= cutoff_date AND"
    " (o_orderstatus <> 'F' OR o_orderdate + to_days((30 + o_orderkey % 360)::INT) > cutoff_date) GROUP BY 1",
)
def b8(spark, sf):
    early = month_ends("1994-10-31", "1995-03-31")  # the first cohorts are empty
    active = spine.active_subscriptions(testbed.subscriptions(spark, sf), early)
    return active.groupBy("cutoff_date").agg(F.count("*").alias("active"))


# --- C: usage ---

CANDIDATES = (
    "SELECT u.subscription_id, c.cutoff_date, u.usage_date, u.feature_name, u.usage_count FROM usage u"
    " JOIN cutoffs c ON u.usage_date <= c.cutoff_date AND u.usage_date >= c.cutoff_date - INTERVAL 28 DAY"
)


@query("c1_usage_candidates", with_(RAW) + CANDIDATES)
def c1(spark, sf):
    events = usage.usage_candidates(testbed.usage(spark, sf), CUTOFFS)
    return events.select("subscription_id", "cutoff_date", "usage_date", "feature_name", "usage_count")


@query(
    "c2_guarded_usage",
    USAGE + "SELECT subscription_id, cutoff_date, usage_date, feature_name, usage_count FROM usage_window",
)
def c2(spark, sf):
    events = usage.guarded_usage(testbed.usage(spark, sf), testbed.subscriptions(spark, sf), CUTOFFS)
    return events.select("subscription_id", "cutoff_date", "usage_date", "feature_name", "usage_count")


def _usage_sums(spark, sf, **options):
    return usage.usage_aggregates(
        testbed.usage(spark, sf), testbed.subscriptions(spark, sf), CUTOFFS, **options
    )


def _usage_features(spark, sf):
    return usage.usage_features(testbed.usage(spark, sf), testbed.subscriptions(spark, sf), CUTOFFS)


SUMS = "SELECT subscription_id, cutoff_date, usage_count, duration_secs, errors FROM usage_sums"


@query("c3_usage_sums", USAGE + SUMS)
def c3(spark, sf):
    return _usage_sums(spark, sf).select(
        "subscription_id", "cutoff_date", "usage_count", "duration_secs", "errors"
    )


@query("c3b_usage_sums_full_window", with_(RAW, ACTIVE, usage_cte(30)) + SUMS)
def c3b(spark, sf):
    return _usage_sums(spark, sf, floor_days=None).select(
        "subscription_id", "cutoff_date", "usage_count", "duration_secs", "errors"
    )


@query("c4_unique_features", USAGE + "SELECT subscription_id, cutoff_date, features FROM usage_sums")
def c4(spark, sf):
    return _usage_sums(spark, sf).select("subscription_id", "cutoff_date", "features")


@query("c5_beta_ratio", USAGE + "SELECT subscription_id, cutoff_date, beta_feature_ratio_30d FROM usage_feats")
def c5(spark, sf):
    return _usage_features(spark, sf).select("subscription_id", "cutoff_date", "beta_feature_ratio_30d")


@query("c6_recent_and_prior", USAGE + "SELECT subscription_id, cutoff_date, coalesce(recent, 0) AS recent, coalesce(prior, 0) AS prior FROM usage_sums")
def c6(spark, sf):
    sums = _usage_sums(spark, sf).select("subscription_id", "cutoff_date", "recent", "prior")
    return sums.na.fill(0)


@query(
    "c7_usage_velocity",
    USAGE + "SELECT subscription_id, cutoff_date, usage_growth_14d_vs_prior14d FROM usage_feats",
)
def c7(spark, sf):
    return _usage_features(spark, sf).select("subscription_id", "cutoff_date", "usage_growth_14d_vs_prior14d")


@query("c8_usage_features", USAGE + "SELECT * FROM usage_feats")
def c8(spark, sf):
    return _usage_features(spark, sf)


# --- D: support ---


@query(
    "d1_tickets_in_window",
    with_(RAW) + "SELECT ticket_id, account_id, cutoff_date, submitted_at FROM tickets JOIN cutoffs"
    " ON submitted_at <= cutoff_date AND submitted_at >= cutoff_date - INTERVAL 60 DAY",
)
def d1(spark, sf):
    rows = support.tickets_in_window(testbed.tickets(spark, sf), CUTOFFS)
    return rows.select("ticket_id", "account_id", "cutoff_date", "submitted_at")


def _guarded(spark, sf):
    return support.guarded_tickets(testbed.tickets(spark, sf), testbed.accounts(spark, sf), CUTOFFS)


@query("d2_guarded_tickets", TICKETS + "SELECT ticket_id, account_id, cutoff_date FROM ticket_window")
def d2(spark, sf):
    return _guarded(spark, sf).select("ticket_id", "account_id", "cutoff_date")


@query(
    "d3_urgent_tickets",
    TICKETS + "SELECT ticket_id, cutoff_date, coalesce(lower(priority) IN ('urgent', 'high'), false) AS is_urgent"
    " FROM ticket_window",
)
def d3(spark, sf):
    return _guarded(spark, sf).select("ticket_id", "cutoff_date", support.is_urgent().alias("is_urgent"))


@query(
    "d4_known_resolution_time",
    TICKETS + "SELECT ticket_id, cutoff_date, CASE WHEN closed_at <= cutoff_date THEN resolution_time_hours END"
    " AS known FROM ticket_window",
)
def d4(spark, sf):
    known = support.known_at_cutoff("resolution_time_hours").alias("known")
    return _guarded(spark, sf).select("ticket_id", "cutoff_date", known)


@query(
    "d5_known_satisfaction",
    TICKETS + "SELECT ticket_id, cutoff_date, CASE WHEN closed_at <= cutoff_date THEN satisfaction_score END"
    " AS known FROM ticket_window",
)
def d5(spark, sf):
    known = support.known_at_cutoff("satisfaction_score").alias("known")
    return _guarded(spark, sf).select("ticket_id", "cutoff_date", known)


@query(
    "d6_known_first_response",
    TICKETS + "SELECT ticket_id, cutoff_date, CASE WHEN submitted_at + to_minutes(first_response_time_minutes)"
    " <= cutoff_date THEN first_response_time_minutes::DOUBLE END AS known FROM ticket_window",
)
def d6(spark, sf):
    known = support.response_known_at_cutoff().cast("double").alias("known")
    return _guarded(spark, sf).select("ticket_id", "cutoff_date", known)


@query("d7_ticket_aggregates", TICKETS + "SELECT * FROM ticket_sums")
def d7(spark, sf):
    return support.ticket_aggregates(testbed.tickets(spark, sf), testbed.accounts(spark, sf), CUTOFFS)


@query("d8_support_features", TICKETS + "SELECT * FROM support_feats")
def d8(spark, sf):
    return support.support_features(
        testbed.subscriptions(spark, sf),
        testbed.accounts(spark, sf),
        testbed.tickets(spark, sf),
        CUTOFFS,
    )


# --- E: assembly ---


@query(
    "e1_feature_join",
    SNAPS + f"SELECT {', '.join(contract.IDENTIFIERS + contract.FEATURES)} FROM snapshots",
)
def e1(spark, sf):
    return snapshots(spark, sf).select(*contract.IDENTIFIERS, *contract.FEATURES)


@query("e2_snapshots", SNAPSHOT_SQL)
def e2(spark, sf):
    return snapshots(spark, sf)


@query("e2b_snapshots_with_salted_keys", SNAPSHOT_SQL)
def e2b(spark, sf):
    """The same table with some keys treated as hot in each of the three salted joins."""
    some = list(range(0, 200, 3))
    return snapshots(spark, sf, hot={"usage": some, "tickets": some, "subscriptions": [None, *some]})


@query("e3_appended_cohorts", SNAPSHOT_SQL)
def e3(spark, sf):
    return append_cohorts(snapshots(spark, sf, CUTOFFS[:9]), snapshots(spark, sf, CUTOFFS[9:]))


@query("e4_leakage_report")
def e4(spark, sf):
    """A raw contract table offered as a snapshot: its end date is reported."""
    return leakage_report(spark, testbed.subscriptions(spark, sf))


def _built(raw, cutoffs, shift_days: int = 0):
    """The snapshot plan; ``shift_days`` plants a leak by dating usage back. No keys are hot here."""
    usage = raw["feature_usage"]
    shifted = usage.withColumn("usage_date", F.col("usage_date") - F.make_dt_interval(F.lit(shift_days)))
    hot = {"usage": [], "tickets": [], "subscriptions": []}
    return build_snapshots(raw["accounts"], raw["subscriptions"], shifted, raw["support_tickets"], cutoffs, hot=hot)


@query(
    "e4b_values_after_replay",
    SNAPS
    + "SELECT s.subscription_id, s.cutoff_date, 'account_age_days' AS column, s.account_age_days::VARCHAR AS stored,"
    " NULL::VARCHAR AS replayed FROM snapshots s JOIN accounts a ON a.account_id = s.account_id"
    " WHERE a.signup_date > s.cutoff_date::TIMESTAMP",
)
def e4b(spark, sf):
    """All snapshots against a replay from what was known at each cutoff: what remains are the ages of
    accounts that sign up after their first contract."""
    return replay_leaks(testbed.raw(spark, sf), CUTOFFS, _built)


PLANTED_DAYS, PLANTED_CUTOFFS = 7, [CUTOFFS[0], CUTOFFS[-1]]
_PLANTED_AT = ", ".join(f"TIMESTAMP '{c}'" for c in PLANTED_CUTOFFS)


@query(
    "e4c_planted_leak",
    with_(
        RAW,
        ACTIVE,
        *[
            f"""
{kind}_sums AS (
  SELECT a.subscription_id, a.cutoff_date, sum(u.usage_count)::DOUBLE AS used, sum(u.error_count)::DOUBLE AS errors
  FROM active a JOIN usage u ON u.subscription_id = a.subscription_id
    AND u.usage_date - INTERVAL {PLANTED_DAYS} DAY <= a.cutoff_date
    AND u.usage_date - INTERVAL {PLANTED_DAYS} DAY >= a.cutoff_date - INTERVAL 28 DAY
    AND u.usage_date - INTERVAL {PLANTED_DAYS} DAY >= a.start_date{known}
  GROUP BY 1, 2)"""
            for kind, known in (("told", ""), ("known", " AND u.usage_date <= a.cutoff_date"))
        ],
    )
    + "SELECT t.subscription_id, t.cutoff_date::DATE::VARCHAR AS cutoff_date, 'usage_count_30d' AS column,"
    " t.used AS stored, coalesce(k.used, 0.0::DOUBLE) AS replayed FROM told_sums t LEFT JOIN known_sums k"
    " USING (subscription_id, cutoff_date) WHERE t.used <> coalesce(k.used, 0)"
    f" AND t.cutoff_date IN ({_PLANTED_AT})"
    " UNION ALL SELECT t.subscription_id, t.cutoff_date::DATE::VARCHAR, 'error_count_30d', t.errors,"
    " coalesce(k.errors, 0.0::DOUBLE) FROM told_sums t LEFT JOIN known_sums k"
    " USING (subscription_id, cutoff_date) WHERE t.errors <> coalesce(k.errors, 0)"
    f" AND t.cutoff_date IN ({_PLANTED_AT})",
)
def e4c(spark, sf):
    """A plan that dates usage back by a week sees a week of the future: the replay of the first and the last
    cutoff finds every such value."""
    leaks = replay_leaks(testbed.raw(spark, sf), PLANTED_CUTOFFS, lambda raw, cutoffs: _built(raw, cutoffs, PLANTED_DAYS))
    shown = leaks.filter(F.col("column").isin("usage_count_30d", "error_count_30d"))
    return shown.withColumns({c: F.col(c).cast("double") for c in ("stored", "replayed")})


BY_CUTOFF = (
    "SELECT cutoff_date, count(*) AS row_count, sum(churn_next_30d)::BIGINT AS churners,"
    " sum(ticket_count_60d) AS ticket_total, sum(usage_count_30d) AS usage_total FROM snapshots GROUP BY 1"
)


@query("e5_snapshot_job", SNAPS + BY_CUTOFF)
def e5(spark, sf):
    """The whole job, from files to files."""
    return _by_cutoff(run_snapshot_job(spark, raw_files(spark, sf), scratch(spark), CUTOFFS))


def _by_cutoff(df: DataFrame) -> DataFrame:
    return df.groupBy("cutoff_date").agg(
        F.count("*").alias("row_count"),
        F.sum("churn_next_30d").alias("churners"),
        F.sum("ticket_count_60d").alias("ticket_total"),
        F.sum("usage_count_30d").alias("usage_total"),
    )


@query("e2c_snapshots_of_whole_span", with_(raw_ctes(*testbed.WHOLE_SPAN), *SNAPSHOTS[1:]) + BY_CUTOFF)
def e2c(spark, sf):
    """All months that the orders span, folded to one row each."""
    return _by_cutoff(snapshots(spark, sf, month_ends(*testbed.WHOLE_SPAN)))


# --- F: preprocessing ---

SCALED = ["active_tenure_days", "seats", "usage_count_30d", "ticket_count_60d", "avg_resolution_time_hours_60d"]


def _scaling_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean,"
        f" round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END, 4) AS scale FROM snapshots"
        for c in columns
    )


@query("f1_scaling_statistics", SNAPS + _scaling_sql(contract.NUMERIC))
def f1(spark, sf):
    stats = scaling_statistics(snapshots(spark, sf), contract.NUMERIC)
    return stats.select("feature", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale"))


def _encoded(spark, sf, preprocessor):
    data = stored(snapshots(spark, sf))  # statistics, labels and matrix
    matrix = preprocessor.fit(data).transform(data).withColumn("slots", vector_to_array("features"))
    first = len(preprocessor.numeric)
    tail = F.slice("slots", first + 1, F.size("slots") - first - 2)
    return matrix.select(
        "subscription_id",
        F.col("cutoff_date"),
        F.size("slots").alias("width"),
        F.aggregate(tail, F.lit(0.0), lambda a, x: a + x).alias("hot_slots"),
        F.element_at("slots", -2).cast("int").alias("is_trial"),
        F.element_at("slots", -1).cast("int").alias("auto_renew_flag"),
    )


def _encoded_sql(numeric: int) -> str:
    widths = " + ".join(f"count(DISTINCT {c})" for c in contract.CATEGORICAL)
    return (
        SNAPS + "SELECT subscription_id, cutoff_date, width, 5.0::DOUBLE AS hot_slots, is_trial, auto_renew_flag"
        f" FROM snapshots, (SELECT ({numeric} + {widths} + 2)::INT AS width FROM snapshots)"
    )


@query("f2_churn_matrix", _encoded_sql(len(contract.NUMERIC)))
def f2(spark, sf):
    return _encoded(spark, sf, churn_preprocessor())


@query("f4_sales_matrix", _encoded_sql(len(contract.SALES_NUMERIC)))
def f4(spark, sf):
    return _encoded(spark, sf, sales_preprocessor())


@query(
    "f3_boolean_passthrough",
    SNAPS + "SELECT subscription_id, cutoff_date, is_trial, auto_renew_flag FROM snapshots",
)
def f3(spark, sf):
    matrix = _encoded(spark, sf, churn_preprocessor())
    return matrix.select("subscription_id", "cutoff_date", "is_trial", "auto_renew_flag")


@query(
    "c9_packed_usage",
    USAGE + "SELECT subscription_id, count(*)::INT AS cutoffs FROM usage_sums GROUP BY 1",
)
def c9(spark, sf):
    packed = pack_by_cutoff(_usage_sums(spark, sf), "subscription_id", "by_cutoff")
    return packed.select("subscription_id", F.size("by_cutoff").alias("cutoffs"))
