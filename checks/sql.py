"""DuckDB building blocks: the domain mapping and the snapshot, written as naive range joins."""

from __future__ import annotations

from checks.testbed import END, START


def raw_ctes(start: str, end: str) -> str:
    return f"""
cutoffs AS (
  SELECT last_day(m)::TIMESTAMP AS cutoff_date
  FROM (SELECT unnest(generate_series(DATE '{start[:8]}01', DATE '{end}', INTERVAL 1 MONTH)) AS m)
  WHERE last_day(m) BETWEEN DATE '{start}' AND DATE '{end}'),
accounts AS (
  SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS industry, n_name AS country,
    first_order + to_days((c_custkey % 700)::INT) + to_hours(c_custkey % 24) AS signup_date,
    CASE c_custkey % 4 WHEN 0 THEN 'organic' WHEN 1 THEN 'partner' WHEN 2 THEN 'ads' ELSE 'direct' END
      AS referral_source
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) ON o_custkey = c_custkey),
subscriptions AS (
  SELECT o_orderkey AS subscription_id, o_custkey AS account_id, o_orderdate AS start_date,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days((30 + o_orderkey % 360)::INT) END AS end_date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Enterprise' WHEN '2-HIGH' THEN 'professional'
      WHEN '3-MEDIUM' THEN 'starter' WHEN '4-NOT SPECIFIED' THEN 'Basic' ELSE 'growth' END AS plan_tier,
    (1 + o_orderkey % 50)::INT AS seats, o_totalprice / 100.0::DOUBLE AS mrr_amount,
    o_totalprice / 100.0::DOUBLE * 12.0::DOUBLE AS arr_amount, o_orderstatus = 'P' AS is_trial,
    CASE WHEN o_orderkey % 3 = 0 THEN 'annual' ELSE 'monthly' END AS billing_frequency,
    CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_orderkey % 2 = 0 END AS auto_renew_flag
  FROM orders),
usage AS (
  SELECT l_orderkey AS subscription_id, l_shipdate AS usage_date, 'f' || (l_partkey % 20) AS feature_name,
    l_quantity::BIGINT AS usage_count, floor(l_extendedprice)::BIGINT AS usage_duration_secs,
    (l_linenumber % 3)::BIGINT AS error_count, l_discount > 0.05 AS is_beta_feature
  FROM lineitem),
tickets AS (
  SELECT *, CASE WHEN ticket_id % 10 <> 0 THEN submitted_at + to_seconds(floor(value * 3600)) END AS closed_at
  FROM (SELECT event_id AS ticket_id, user_id AS account_id, value,
    ts - to_days((8888 + 30 * (event_id % 24))::INT) AS submitted_at,
    floor(value * 4) / 4.0::DOUBLE AS resolution_time_hours,
    CASE event_type WHEN 'error' THEN 'URGENT' WHEN 'purchase' THEN 'High' WHEN 'click' THEN 'medium'
      WHEN 'view' THEN 'low' END AS priority,
    CASE WHEN event_id % 7 <> 0 THEN event_id % 600 END AS first_response_time_minutes,
    CASE WHEN event_id % 3 <> 0 THEN (1 + event_id % 5)::DOUBLE END AS satisfaction_score,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 4 = 0 END AS escalation_flag
  FROM events))"""


RAW = raw_ctes(START, END)

ACTIVE = """
active AS (
  SELECT s.*, c.cutoff_date FROM subscriptions s JOIN cutoffs c
    ON s.start_date <= c.cutoff_date AND (s.end_date IS NULL OR s.end_date > c.cutoff_date)),
targets AS (
  SELECT subscription_id, cutoff_date, churn_next_30d,
    CASE WHEN churn_next_30d = 1 THEN 0.0::DOUBLE ELSE mrr_amount END AS future_mrr_30d
  FROM (SELECT *, (CASE WHEN end_date > cutoff_date AND end_date <= cutoff_date + INTERVAL 30 DAY
      THEN 1 ELSE 0 END)::INT AS churn_next_30d FROM active))"""


def usage_cte(floor_days: int = 28) -> str:
    return f"""
usage_window AS (
  SELECT a.subscription_id, a.cutoff_date, u.usage_date, u.feature_name, u.usage_count,
    u.usage_duration_secs, u.error_count, u.is_beta_feature,
    u.usage_date >= a.cutoff_date - INTERVAL 30 DAY AS in_window,
    u.usage_date > a.cutoff_date - INTERVAL 14 DAY AS is_recent,
    u.usage_date > a.cutoff_date - INTERVAL 28 DAY AND u.usage_date <= a.cutoff_date - INTERVAL 14 DAY AS is_prior
  FROM active a JOIN usage u ON u.subscription_id = a.subscription_id
  WHERE u.usage_date <= a.cutoff_date AND u.usage_date >= a.cutoff_date - INTERVAL {floor_days} DAY
    AND u.usage_date >= a.start_date),
usage_sums AS (
  SELECT subscription_id, cutoff_date,
    sum(usage_count) FILTER (in_window)::BIGINT AS usage_count,
    sum(usage_duration_secs) FILTER (in_window)::BIGINT AS duration_secs,
    sum(error_count) FILTER (in_window)::BIGINT AS errors,
    count(DISTINCT feature_name) FILTER (in_window) AS features,
    sum(usage_count) FILTER (in_window AND is_beta_feature)::BIGINT AS beta_count,
    sum(usage_count) FILTER (is_recent)::BIGINT AS recent,
    sum(usage_count) FILTER (is_prior)::BIGINT AS prior
  FROM usage_window GROUP BY 1, 2),
usage_feats AS (
  SELECT a.subscription_id, a.cutoff_date,
    coalesce(usage_count, 0)::DOUBLE AS usage_count_30d,
    coalesce(duration_secs, 0)::DOUBLE AS usage_duration_secs_30d,
    coalesce(errors, 0)::DOUBLE AS error_count_30d,
    coalesce(features, 0)::DOUBLE AS unique_features_30d,
    CASE WHEN usage_count > 0 THEN coalesce(beta_count, 0)::DOUBLE / usage_count::DOUBLE ELSE 0.0::DOUBLE END
      AS beta_feature_ratio_30d,
    (coalesce(recent, 0)::DOUBLE - coalesce(prior, 0)::DOUBLE) / (coalesce(prior, 0)::DOUBLE + 1.0::DOUBLE)
      AS usage_growth_14d_vs_prior14d
  FROM active a LEFT JOIN usage_sums u USING (subscription_id, cutoff_date))"""


SUPPORT = """
ticket_window AS (
  SELECT t.*, c.cutoff_date FROM tickets t JOIN accounts a USING (account_id) JOIN cutoffs c
    ON t.submitted_at <= c.cutoff_date AND t.submitted_at >= c.cutoff_date - INTERVAL 60 DAY
  WHERE t.submitted_at >= a.signup_date),
ticket_sums AS (
  SELECT account_id, cutoff_date, count(ticket_id) AS tickets,
    sum(CASE WHEN lower(priority) IN ('urgent', 'high') THEN 1 ELSE 0 END)::BIGINT AS urgent,
    sum(CASE WHEN escalation_flag THEN 1 ELSE 0 END)::BIGINT AS escalated,
    avg(CASE WHEN closed_at <= cutoff_date THEN resolution_time_hours END) AS resolution_hours,
    avg(CASE WHEN submitted_at + to_minutes(first_response_time_minutes) <= cutoff_date
      THEN first_response_time_minutes END) AS response_minutes,
    avg(CASE WHEN closed_at <= cutoff_date THEN satisfaction_score END) AS satisfaction,
    count(CASE WHEN closed_at <= cutoff_date THEN satisfaction_score END) AS satisfaction_responses
  FROM ticket_window GROUP BY 1, 2),
support_feats AS (
  SELECT a.subscription_id, a.cutoff_date,
    coalesce(tickets, 0)::DOUBLE AS ticket_count_60d,
    coalesce(urgent, 0)::DOUBLE AS urgent_ticket_count_60d,
    coalesce(escalated, 0)::DOUBLE AS escalation_count_60d,
    coalesce(resolution_hours, 0)::DOUBLE AS avg_resolution_time_hours_60d,
    coalesce(response_minutes, 0)::DOUBLE AS avg_first_response_time_minutes_60d,
    coalesce(satisfaction, 0)::DOUBLE AS avg_satisfaction_score_60d,
    coalesce(satisfaction_responses, 0)::DOUBLE AS satisfaction_response_count_60d
  FROM active a LEFT JOIN ticket_sums t USING (account_id, cutoff_date))"""

# 24-hour days elapsed, floored; DuckDB's datediff counts midnights instead.
ACCOUNT_AGE = "greatest(0, floor(epoch(s.cutoff_date - signup_date) / 86400))::INT"

SNAPSHOT = f"""
snapshots AS (
  SELECT s.subscription_id, s.account_id, s.cutoff_date::DATE::VARCHAR AS cutoff_date,
    CASE WHEN signup_date IS NOT NULL THEN {ACCOUNT_AGE} END AS account_age_days,
    datediff('day', start_date, s.cutoff_date)::INT AS active_tenure_days,
    seats, mrr_amount, arr_amount, u.* EXCLUDE (subscription_id, cutoff_date),
    t.* EXCLUDE (subscription_id, cutoff_date), industry, country, referral_source, plan_tier,
    billing_frequency, coalesce(is_trial, false)::INT AS is_trial,
    coalesce(auto_renew_flag, false)::INT AS auto_renew_flag, churn_next_30d, future_mrr_30d
  FROM active s LEFT JOIN accounts USING (account_id)
  JOIN usage_feats u ON u.subscription_id = s.subscription_id AND u.cutoff_date = s.cutoff_date
  JOIN support_feats t ON t.subscription_id = s.subscription_id AND t.cutoff_date = s.cutoff_date
  JOIN targets g ON g.subscription_id = s.subscription_id AND g.cutoff_date = s.cutoff_date)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


SNAPSHOTS = (RAW, ACTIVE, usage_cte(), SUPPORT, SNAPSHOT)

# --- The scored population and the serving tables of checks.testbed ---

SCORED = """
scored AS (
  SELECT s.subscription_id, s.account_id, s.cutoff_date::DATE AS cutoff_date, s.mrr_amount, churn_next_30d,
    future_mrr_30d, ((s.subscription_id * 7919 + month(s.cutoff_date) * 613) % 10000)::DOUBLE / 10000.0::DOUBLE
      AS churn_probability,
    s.mrr_amount * ((60 + s.subscription_id % 81)::DOUBLE / 100.0::DOUBLE) - 300.0::DOUBLE AS raw_forecast,
    greatest(0.0::DOUBLE, s.mrr_amount * ((60 + s.subscription_id % 81)::DOUBLE / 100.0::DOUBLE) - 300.0::DOUBLE)
      AS predicted_sales
  FROM active s JOIN targets t ON t.subscription_id = s.subscription_id AND t.cutoff_date = s.cutoff_date),
holdout AS (SELECT * FROM scored WHERE cutoff_date >= DATE '1999-05-31')"""

SERVING = """
predictions AS (
  SELECT *, greatest(0, predicted_sales - 150.25)::DECIMAL(8,2) AS sales_lower_bound,
    (predicted_sales + 150.25)::DECIMAL(8,2) AS sales_upper_bound
  FROM (SELECT 'run-' || strftime(cutoff_date, '%Y-%m') AS run_id, account_id::VARCHAR AS customer_id,
    subscription_id, cutoff_date, churn_next_30d AS actual_churn,
    (basis::DOUBLE / 10000.0::DOUBLE)::DECIMAL(5,4) AS churn_probability,
    (floor(future_mrr_30d * 100) / 100.0::DOUBLE)::DECIMAL(8,2) AS actual_sales,
    (floor(mrr_amount * (80 + subscription_id % 41)) / 100.0::DOUBLE)::DECIMAL(8,2) AS predicted_sales,
    CASE subscription_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'annual plan' ELSE 'auto renew' END AS prescriptive_action,
    ((CASE subscription_id % 3 WHEN 0 THEN basis WHEN 1 THEN (basis * 7) // 10 ELSE (basis * 4) // 10 END)::DOUBLE / 10000.0::DOUBLE)
      ::DECIMAL(5,4) AS prescribed_risk_drop, cutoff_date::TIMESTAMP AS created_at
  FROM (SELECT *, (subscription_id * 7919 + month(cutoff_date) * 613) % 10000 AS basis FROM holdout))),
telemetry AS (
  SELECT 'run-' || strftime(cutoff_date, '%Y-%m') AS run_id, 'v' || m AS model_version,
    (0.70::DOUBLE + (n % 97) / 1000.0::DOUBLE)::DECIMAL(5,4) AS churn_auc,
    (0.05::DOUBLE + (churners % 50) / 1000.0::DOUBLE)::DECIMAL(5,4) AS sales_mape,
    (10 + (n % 1000) / 10.0::DOUBLE)::DECIMAL(8,2) AS sales_rmse,
    CASE WHEN m <> 6 THEN (5 + (n % 1000) / 20.0::DOUBLE)::DECIMAL(8,2) END AS sales_mae,
    (0.04::DOUBLE + m / 1000.0::DOUBLE)::DECIMAL(5,4) AS sales_wmape,
    ((m - 4) * 6 / 100.0::DOUBLE)::DECIMAL(5,4) AS psi_score, (m - 4) * 6 > 20 AS drift_flag,
    n::INT AS test_sample_count,
    CASE WHEN m <> 7 THEN ((80 + m) / 100.0::DOUBLE)::DECIMAL(7,6) END AS risk_threshold,
    (n // 10)::INT AS risk_queue_count, 0.5::DECIMAL(5,4) AS risk_queue_recall,
    0.25::DECIMAL(5,4) AS risk_queue_precision, (m / 4.0::DOUBLE)::DECIMAL(6,2) AS risk_queue_lift,
    'month ' || m AS notes, cutoff_date::TIMESTAMP + INTERVAL 1 HOUR AS created_at
  FROM (SELECT cutoff_date, month(cutoff_date) AS m, count(*) AS n, sum(churn_next_30d)::BIGINT AS churners
    FROM holdout GROUP BY 1))"""

DIRTY = """
dirty AS (
  SELECT CASE WHEN subscription_id % 59 = 0 THEN 'run-missing' ELSE run_id END AS run_id, customer_id,
    subscription_id, cutoff_date, CASE WHEN subscription_id % 71 = 0 THEN 2 ELSE actual_churn END AS actual_churn,
    CASE WHEN subscription_id % 50 = 0 THEN 1.5::DOUBLE ELSE churn_probability::DOUBLE END AS churn_probability,
    actual_sales,
    CASE WHEN subscription_id % 67 = 0 THEN 12345678.9::DOUBLE ELSE predicted_sales::DOUBLE END AS predicted_sales,
    CASE WHEN subscription_id % 53 = 0 THEN sales_upper_bound::DOUBLE + 1 ELSE sales_lower_bound::DOUBLE END
      AS sales_lower_bound, sales_upper_bound::DOUBLE AS sales_upper_bound,
    CASE WHEN subscription_id % 61 = 0 THEN NULL ELSE prescriptive_action END AS prescriptive_action,
    CASE WHEN subscription_id % 73 = 0 THEN NULL ELSE prescribed_risk_drop::DOUBLE END AS prescribed_risk_drop
  FROM predictions)"""

LATEST = """
latest_run AS (SELECT * FROM telemetry ORDER BY created_at DESC, run_id DESC LIMIT 1),
latest AS (
  SELECT p.*, l.model_version, l.churn_auc, l.sales_mape, l.sales_rmse, l.sales_mae, l.sales_wmape, l.psi_score,
    l.drift_flag, l.risk_threshold, l.risk_queue_lift, l.created_at AS run_timestamp,
    CASE WHEN l.risk_threshold IS NOT NULL AND p.churn_probability >= l.risk_threshold
        THEN 'Top-10% Operational Risk Queue'
      WHEN p.churn_probability >= 0.75 THEN 'Tier 1 - Critical Risk (>75%)'
      WHEN p.churn_probability >= 0.50 THEN 'Tier 2 - Elevated Risk (50-75%)'
      WHEN p.churn_probability >= 0.25 THEN 'Tier 3 - Moderate Risk (25-50%)'
      ELSE 'Tier 4 - Stable (<25%)' END AS risk_tier,
    p.churn_probability >= coalesce(l.risk_threshold, 0.50) AND p.prescribed_risk_drop < p.churn_probability
      AS is_recoverable_revenue
  FROM predictions p JOIN latest_run l USING (run_id))"""
