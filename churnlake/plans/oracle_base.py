"""DuckDB oracles: the same queries in ANSI SQL over the given tables.

``CUSTOMERS_SQL`` is the customer-table definition of FIXTURES.md F1; every
oracle composes it as a CTE, so the oracle reads the same parquet tables as
the Spark plan.
"""

from __future__ import annotations

CUSTOMERS_SQL = """
WITH c0 AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS cutoff FROM orders),
ord AS (
  SELECT o_custkey,
         min(CASE WHEN o_orderdate <= cutoff THEN o_orderdate END) AS first_o,
         max(CASE WHEN o_orderdate <= cutoff THEN o_orderdate END) AS last_o,
         CAST(sum(CASE WHEN o_orderdate <= cutoff THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS spend_cents,
         sum(CASE WHEN o_orderdate >  cutoff THEN 1 ELSE 0 END) AS future_orders
  FROM orders CROSS JOIN c0 GROUP BY o_custkey),
li AS (
  SELECT o_custkey,
         count(DISTINCT CASE WHEN o_orderdate > cutoff - INTERVAL 365 DAY THEN p_brand END) AS brands,
         avg(CASE WHEN l_discount >= 0.06 THEN 1.0E0 ELSE 0.0E0 END) AS disc_rate,
         count(DISTINCT CASE WHEN o_orderdate > cutoff - INTERVAL 365 DAY AND date_diff('day', o_orderdate, l_shipdate) > 60 THEN o_orderkey END) AS late12,
         sum(CASE WHEN l_returnflag='R' AND o_orderdate > cutoff - INTERVAL 365 DAY THEN 1 ELSE 0 END) AS ret12
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey CROSS JOIN c0
  WHERE o_orderdate <= cutoff GROUP BY o_custkey),
ev AS (
  SELECT user_id,
         sum(CASE WHEN event_type='view' THEN 1 ELSE 0 END) AS views,
         sum(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS clicks,
         sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS errors,
         sum(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS purchases,
         sum(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) AS signups
  FROM events GROUP BY user_id),
j AS (
SELECT concat('CUST', CAST(100000+c_custkey AS VARCHAR)) AS customer_id, c_custkey,
  18 + (c_custkey*7919) % 53 AS age,
  CASE WHEN c_custkey%25=0 THEN 'Other' WHEN c_custkey%2=0 THEN 'Female' ELSE 'Male' END AS gender,
  concat('Tier ', CAST(1 + c_nationkey%3 AS VARCHAR)) AS city_tier,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'Basic' WHEN c_mktsegment IN ('FURNITURE','HOUSEHOLD') THEN 'Standard' ELSE 'Premium' END AS subscription_type,
  CASE WHEN c_custkey%9 < 5 THEN 'Monthly' WHEN c_custkey%9 < 7 THEN 'Quarterly' ELSE 'Annual' END AS contract_type,
  CASE c_nationkey%5 WHEN 0 THEN 'Email' WHEN 1 THEN 'Organic Search' WHEN 2 THEN 'Paid Ads' WHEN 3 THEN 'Referral' ELSE 'Social Media' END AS marketing_channel,
  CAST(greatest(1, floor(date_diff('day', first_o, cutoff)/30.0)) AS INT) AS raw_months,
  coalesce(spend_cents,0) AS spend_cents,
  coalesce(views,0) AS website_visits_last_30d, coalesce(clicks,0) AS app_sessions_last_30d,
  CAST(floor(coalesce(errors,0)/5.0) AS INT) AS support_tickets_last_90d,
  coalesce(late12,0) AS late_payments_last_12m, coalesce(disc_rate,0.0E0) AS discount_usage_rate,
  coalesce(purchases*1.0E0/nullif(purchases+signups,0),0.0E0) AS email_open_rate,
  CAST(greatest(-100,least(100,floor((c_acctbal-1500)/85.0))) AS INT) AS nps_score,
  least(8, coalesce(brands,0)) AS products_owned, coalesce(ret12,0) AS returns_last_12m,
  date_diff('day', last_o, cutoff) AS days_since_last_purchase,
  CASE WHEN future_orders=0 THEN 1 ELSE 0 END AS churned_observed, first_o
FROM customer LEFT JOIN ord ON o_custkey=c_custkey LEFT JOIN li ON li.o_custkey=c_custkey LEFT JOIN ev ON ev.user_id = c_custkey//10 CROSS JOIN c0),
k AS (SELECT j.*, CAST(greatest(1, floor(raw_months * (c_custkey%10 + 1) / 10.0)) AS INT) AS tenure_months FROM j),
y AS (SELECT k.*, 0.04E0*(30-tenure_months) + 0.5E0*late_payments_last_12m + 0.3E0*support_tickets_last_90d
             + coalesce(days_since_last_purchase,400)/300.0E0 + ((c_custkey*7919)%101)/101.0E0 AS z FROM k),
w AS (SELECT y.*, CASE WHEN z > 2.95E0 THEN 1 ELSE 0 END AS churned FROM y)
SELECT customer_id, CAST(age AS INT) AS age, gender, city_tier,
  tenure_months,
  subscription_type, contract_type, marketing_channel,
  (spend_cents // (raw_months * 300)) / 100.0E0 AS avg_monthly_spend_usd,
  CAST(website_visits_last_30d AS INT) AS website_visits_last_30d, CAST(app_sessions_last_30d AS INT) AS app_sessions_last_30d,
  support_tickets_last_90d, CAST(late_payments_last_12m AS INT) AS late_payments_last_12m,
  CAST(discount_usage_rate AS DOUBLE) AS discount_usage_rate, CAST(email_open_rate AS DOUBLE) AS email_open_rate,
  nps_score, CAST(products_owned AS INT) AS products_owned, CAST(returns_last_12m AS INT) AS returns_last_12m,
  CAST(days_since_last_purchase AS INT) AS days_since_last_purchase,
  (spend_cents // 1000) / 100.0E0 AS estimated_clv_usd,
  CASE WHEN spend_cents < 130000000 THEN 'Low' WHEN spend_cents < 230000000 THEN 'Medium' ELSE 'High' END AS clv_segment,
  CASE WHEN churned=1 AND c_custkey%2=0 THEN 'Targeted win-back campaign' WHEN churned=1 THEN 'Immediate retention offer'
       WHEN c_custkey%2=0 THEN 'Loyalty upsell' ELSE 'Standard nurture' END AS recommended_action,
  CAST(churned AS INT) AS churned, CAST(churned_observed AS INT) AS churned_observed,
  CASE WHEN (c_custkey//10)%5=4 THEN 'test' ELSE 'train' END AS split
FROM w
"""


def base_ctes() -> str:
    return (f"customers AS ({CUSTOMERS_SQL}),\n"
            "train AS (SELECT * FROM customers WHERE split = 'train'),\n"
            "test AS (SELECT * FROM customers WHERE split = 'test')")


def stats_sql(src: str) -> str:
    return (f"SELECT max(late_payments_last_12m) AS _max_late, quantile_cont(nps_score, 0.33) AS _q0, "
            f"quantile_cont(nps_score, 0.66) AS _q1 FROM {src}")


def cut_sql(x: str, edges, labels, right: bool = True) -> str:
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        conds = []
        if lo is not None and lo != float("-inf"):
            conds.append(f"{x} {'>' if right else '>='} {lo}")
        if hi is not None and hi != float("inf"):
            conds.append(f"{x} {'<=' if right else '<'} {hi}")
        cond = " AND ".join(conds) if conds else f"{x} IS NOT NULL"
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


def features_sql(src: str, stats_src: str | None = None) -> str:
    """FE4-FE16 over table ``src`` with statistics of ``stats_src`` (default: itself)."""
    from .oracle_values import (AGE_EDGES, AGE_LABELS, NPS_LABELS, RECENCY_EDGES, RECENCY_LABELS,
                                      TENURE_EDGES, TENURE_LABELS)
    st = stats_sql(stats_src or src)
    t1 = "CASE WHEN s.tenure_months IS NULL THEN NULL ELSE greatest(s.tenure_months, 1) END"
    wa = "(s.website_visits_last_30d + s.app_sessions_last_30d)"
    risk = ("(CAST(coalesce(s.late_payments_last_12m >= 2, false) AS INT) + "
            "CAST(coalesce(s.support_tickets_last_90d >= 3, false) AS INT) + "
            "CAST(coalesce(s.days_since_last_purchase >= 60, false) AS INT) + "
            "CAST(coalesce(s.email_open_rate < 0.3, false) AS INT) + "
            "CAST(coalesce(s.nps_score < 0, false) AS INT))")
    return f"""SELECT s.*,
  {wa} AS engagement_score,
  s.avg_monthly_spend_usd / {t1} AS spend_per_tenure,
  s.support_tickets_last_90d / {t1} AS support_intensity,
  1.0E0 - s.late_payments_last_12m / greatest(st._max_late, 1) AS payment_reliability,
  s.estimated_clv_usd / CASE WHEN s.avg_monthly_spend_usd IS NULL THEN NULL ELSE greatest(s.avg_monthly_spend_usd * 12, 1) END AS clv_spend_ratio,
  {cut_sql('s.days_since_last_purchase', RECENCY_EDGES, RECENCY_LABELS)} AS recency_bucket,
  {cut_sql('s.age', AGE_EDGES, AGE_LABELS)} AS age_group,
  {cut_sql('s.tenure_months', TENURE_EDGES, TENURE_LABELS)} AS tenure_category,
  CASE WHEN s.nps_score <= st._q0 THEN '{NPS_LABELS[0]}' WHEN s.nps_score <= st._q1 THEN '{NPS_LABELS[1]}'
       WHEN s.nps_score IS NOT NULL THEN '{NPS_LABELS[2]}' END AS nps_category,
  {risk} AS risk_score,
  CAST({risk} >= 3 AS INT) AS high_risk,
  s.app_sessions_last_30d / CASE WHEN {wa} IS NULL THEN NULL ELSE greatest({wa}, 1) END AS digital_preference,
  s.discount_usage_rate * (1.0E0 - s.email_open_rate) AS discount_dependency
FROM {src} s CROSS JOIN ({st}) st"""


def with_features(stats_from: str = "self") -> str:
    """CTEs base + train_feat + test_feat."""
    te_stats = "train" if stats_from == "train" else "test"
    return (base_ctes() + ",\n"
            f"train_feat AS ({features_sql('train')}),\n"
            f"test_feat AS ({features_sql('test', te_stats)})")


SCORE_SQL = ("round_even(1.0E0 / (1.0E0 + exp(-(0.04E0 * (30 - tenure_months) + 0.5E0 * late_payments_last_12m "
             "- 1.0E0))), 4)")


def scores_cte() -> str:
    return (f"scores AS (SELECT customer_id, CAST({SCORE_SQL} >= 0.5 AS INT) AS churn_prediction, "
            f"{SCORE_SQL} AS churn_probability FROM test)")


def sig4_sql(z: str) -> str:
    return f"round_even(1.0E0 / (1.0E0 + exp(-({z}))), 4)"


ZA = "0.04E0 * (30 - tenure_months) + 0.5E0 * late_payments_last_12m - 1.0E0"
ZB = "0.3E0 * support_tickets_last_90d + coalesce(days_since_last_purchase, 400) / 300.0E0 - 1.5E0"
ZC = f"{ZA} + 0.3E0 * support_tickets_last_90d"


def scorers_cte(src: str, name: str = "scorers") -> str:
    return (f"{name} AS (SELECT customer_id, churned AS label, {sig4_sql(ZA)} AS p_a, {sig4_sql(ZB)} AS p_b, "
            f"{sig4_sql(ZC)} AS p_c FROM {src})")


def scorer_long_cte(src: str, name: str = "sl") -> str:
    return (scorers_cte(src, "_sc") + f""",
{name} AS (
  SELECT 'rule_a' AS model, customer_id, label, p_a AS score, CAST(p_a >= 0.5 AS INT) AS prediction FROM _sc
  UNION ALL SELECT 'rule_b', customer_id, label, p_b, CAST(p_b >= 0.5 AS INT) FROM _sc
  UNION ALL SELECT 'rule_c', customer_id, label, p_c, CAST(p_c >= 0.5 AS INT) FROM _sc)""")
