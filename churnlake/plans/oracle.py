"""DuckDB oracle SQL per S query of the catalog (same keys, same column names).

Written independently of the Spark plans: plain SQL over the given parquet
tables, with the customer table of FIXTURES.md F1 as a CTE. Long column lists
(unpivots, one-hot columns) are generated from the fixed definitions.
"""

from __future__ import annotations

from ..sources.customers import CUSTOMER_SCHEMA
from .catalog import FEATURE_IDS
from .oracle_base import base_ctes, cut_sql, scorer_long_cte, scorers_cte, scores_cte, with_features
from .oracle_values import (AGE_LABELS, CATEGORICAL_FEATURES, CHANNELS, CHURN_ACTIONS, NEW_FEATURES, NON_NEGATIVE, NPS_LABELS,
                            NUMERICAL_FEATURES, PAYMENT_EDGES, PAYMENT_LABELS, RATE_COLS, RECENCY_EDGES, RECENCY_LABELS,
                            TENURE_IMPACT_EDGES, TENURE_IMPACT_LABELS, TENURE_LABELS)

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def q(name: str) -> str:
    """Quoted identifier."""
    return '"' + name.replace('"', '""') + '"'


def rate(col: str = "churned") -> str:
    return f"round_even(avg(CAST({col} AS DOUBLE)) * 100.0E0, 1)"


CUST_TYPES = {f.name: f.dataType.simpleString() for f in CUSTOMER_SCHEMA.fields}
STRING_COLS = [c for c, t in CUST_TYPES.items() if t == "string"]
NUMERIC_COLS = [c for c, t in CUST_TYPES.items() if t in ("int", "double", "bigint")]
INT_COLS = [c for c, t in CUST_TYPES.items() if t == "int"]
DOUBLE_COLS = [c for c, t in CUST_TYPES.items() if t == "double"]

# Types of the engineered numeric features (as Spark derives them).
NEW_NUMERIC_TYPES = {"engagement_score": "int", "spend_per_tenure": "double", "support_intensity": "double",
                     "payment_reliability": "double", "clv_spend_ratio": "double", "risk_score": "int",
                     "high_risk": "int", "digital_preference": "double", "discount_dependency": "double"}
FEAT_TYPES = {**CUST_TYPES, **NEW_NUMERIC_TYPES}

# Category levels of the one-hot encoding: fixed by the customer-table and
# bin definitions (all of them occur in train at every test scale).
LEVELS = {
    "gender": ["Female", "Male", "Other"],
    "city_tier": ["Tier 1", "Tier 2", "Tier 3"],
    "subscription_type": ["Basic", "Premium", "Standard"],
    "contract_type": ["Annual", "Monthly", "Quarterly"],
    "marketing_channel": sorted(CHANNELS),
    "clv_segment": ["High", "Low", "Medium"],
    "recency_bucket": sorted(RECENCY_LABELS),
    "age_group": sorted(AGE_LABELS),
    "tenure_category": sorted(TENURE_LABELS),
    "nps_category": sorted(NPS_LABELS),
}
DUMMIES = {f"{c}_{v}": f"CAST(coalesce({c} = '{v}', false) AS INT)" for c in CATEGORICAL_FEATURES for v in LEVELS[c]}
ENC_EXPR = {**{f: f for f in NUMERICAL_FEATURES}, **DUMMIES}
ENC_FEATURES = sorted(ENC_EXPR)
ENC_TYPES = {**{f: FEAT_TYPES[f] for f in NUMERICAL_FEATURES}, **{d: "int" for d in DUMMIES}}


def enc_cte() -> str:
    cols = ", ".join(f"{ENC_EXPR[f]} AS {q(f)}" for f in ENC_FEATURES)
    return (f"enc_train AS (SELECT customer_id, {cols}, churned FROM train_feat),\n"
            f"enc_test AS (SELECT customer_id, {cols} FROM test_feat)")


def directory_cte() -> str:
    soft = ("(1.0E0 / (1.0E0 + exp(-(ln(least(greatest(churn_probability, 0.001), 0.999) / "
            "(1.0E0 - least(greatest(churn_probability, 0.001), 0.999))) / 2.5E0))) * 100.0E0)")
    return f"""{scores_cte()},
_dj AS (SELECT s.customer_id, s.churn_probability, t.estimated_clv_usd, t.tenure_months, {soft} AS p
        FROM scores s JOIN test t ON s.customer_id = t.customer_id),
dir AS (SELECT customer_id AS id, CAST(trunc(estimated_clv_usd) AS INT) AS clv, CAST(trunc(tenure_months) AS INT) AS tenure,
  CAST(trunc(p) AS INT) AS riskScore,
  CASE WHEN p > 70 THEN 'At Risk' WHEN p > 35 THEN 'Monitoring' ELSE 'Healthy' END AS status,
  CAST(CAST(trunc(p % 14 + 1) AS INT) AS VARCHAR) || ' days ago' AS lastActive, churn_probability FROM _dj)"""


def importance_cte(src: str = "enc_train") -> str:
    aggs = []
    for i, f in enumerate(ENC_FEATURES):
        x = f"CAST({q(f)} AS DOUBLE)"
        y = "CAST(churned AS DOUBLE)"
        aggs.append(f"covar_samp({x}, {y}) / nullif(stddev_samp(CASE WHEN churned IS NOT NULL THEN {x} END) * "
                    f"stddev_samp(CASE WHEN {q(f)} IS NOT NULL THEN {y} END), 0) AS r{i}")
        aggs.append(f"avg({x}) FILTER (WHERE churned = 1) AS m1_{i}, avg({x}) FILTER (WHERE churned = 0) AS m0_{i}, "
                    f"min({x}) AS lo{i}, max({x}) AS hi{i}")
    unp = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, coalesce(abs(r{i}), 0.0E0) AS a, "
        f"coalesce(abs(m1_{i} - m0_{i}) / nullif(hi{i} - lo{i}, 0), 0.0E0) AS b FROM _irow"
        for i, f in enumerate(ENC_FEATURES))
    return f"""_irow AS (SELECT {', '.join(aggs)} FROM {src}),
_ilong AS ({unp}),
imp AS (SELECT feature, round_even(a / sum(a) OVER (), 6) AS imp_a, round_even(b / sum(b) OVER (), 6) AS imp_b FROM _ilong),
comb AS (SELECT feature, imp_a, imp_b,
  CAST(rank() OVER (ORDER BY imp_a DESC NULLS LAST) AS DOUBLE) + (count(*) OVER (PARTITION BY imp_a) - 1) / 2.0E0 AS rank_a,
  CAST(rank() OVER (ORDER BY imp_b DESC NULLS LAST) AS DOUBLE) + (count(*) OVER (PARTITION BY imp_b) - 1) / 2.0E0 AS rank_b
  FROM imp),
combined AS (SELECT *, (rank_a + rank_b) / 2.0E0 AS avg_rank FROM comb)"""


def metrics_cte(src: str, label: str, pred: str, score: str, group: str | None, name: str) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""_c_{name} AS (SELECT {g}count(*) FILTER (WHERE {label} = 0 AND {pred} = 0) AS tn,
  count(*) FILTER (WHERE {label} = 0 AND {pred} = 1) AS fp, count(*) FILTER (WHERE {label} = 1 AND {pred} = 0) AS fn,
  count(*) FILTER (WHERE {label} = 1 AND {pred} = 1) AS tp FROM {src} {gb}),
_d_{name} AS (SELECT {g}{score} AS s, count(*) FILTER (WHERE {label} = 1) AS pos, count(*) FILTER (WHERE {label} = 0) AS neg
  FROM {src} GROUP BY {g}{score}),
_u_{name} AS (SELECT {g}pos, neg, coalesce(sum(neg) OVER (PARTITION BY {group or 'NULL'} ORDER BY s
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM _d_{name}),
_a_{name} AS (SELECT {g}round_even(sum(pos * (below + neg / 2.0E0)) / (sum(pos) * sum(neg)), 6) AS roc_auc
  FROM _u_{name} {gb}),
{name} AS (SELECT {'c.' + group + ', ' if group else ''}
  round_even((tp + tn) * 1.0E0 / (tp + tn + fp + fn), 6) AS accuracy,
  round_even(coalesce(2.0E0 * tp / nullif(2 * tp + fp + fn, 0), 0.0E0), 6) AS f1,
  round_even(coalesce(tp * 1.0E0 / nullif(tp + fp, 0), 0.0E0), 6) AS precision,
  round_even(coalesce(tp * 1.0E0 / nullif(tp + fn, 0), 0.0E0), 6) AS recall, a.roc_auc
  FROM _c_{name} c {'JOIN _a_' + name + ' a ON c.' + group + ' = a.' + group if group else 'CROSS JOIN _a_' + name + ' a'})"""


def ranked_cte() -> str:
    return (scorer_long_cte("train", "sl") + ",\n" + metrics_cte("sl", "label", "prediction", "score", "model", "mm")
            + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY f1 DESC, model ASC) AS rank,
  row_number() OVER (ORDER BY f1 DESC, model ASC) = 1 AS is_champion FROM mm)""")


def lever_cte() -> str:
    tenure = cut_sql("tenure_months", TENURE_IMPACT_EDGES, TENURE_IMPACT_LABELS, right=False)
    pay = cut_sql("late_payments_last_12m", PAYMENT_EDGES, PAYMENT_LABELS, right=True)
    return f"""li AS (
  SELECT 'clv' AS tbl, clv_segment AS label, {rate()} AS churnRate, CAST(NULL AS BIGINT) AS count FROM train
    WHERE clv_segment IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'tenure', b, {rate()}, count(*) FROM (SELECT {tenure} AS b, churned FROM train) WHERE b IS NOT NULL GROUP BY b
  UNION ALL SELECT 'contract', contract_type, {rate()}, count(*) FROM train WHERE contract_type IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'payment', b, {rate()}, count(*) FROM (SELECT {pay} AS b, churned FROM train) WHERE b IS NOT NULL GROUP BY b
  UNION ALL SELECT 'nps', nps_category, {rate()}, count(*) FROM train_feat WHERE nps_category IS NOT NULL GROUP BY 2),
rr AS (SELECT
  max(churnRate) FILTER (WHERE tbl = 'contract' AND label = 'Monthly') AS monthly_rate,
  max(churnRate) FILTER (WHERE tbl = 'contract' AND label = 'Annual') AS annual_rate,
  max(churnRate) FILTER (WHERE tbl = 'nps' AND label = 'Detractor') AS detractor_rate,
  max(churnRate) FILTER (WHERE tbl = 'nps' AND label = 'Promoter') AS promoter_rate,
  max(churnRate) FILTER (WHERE tbl = 'clv' AND label = 'Low') AS low_clv_rate,
  max(churnRate) FILTER (WHERE tbl = 'clv' AND label = 'Medium') AS medium_clv_rate,
  max(churnRate) FILTER (WHERE tbl = 'clv' AND label = 'High') AS high_clv_rate,
  max(churnRate) FILTER (WHERE tbl = 'payment' AND label = '0 Late') AS late0_rate,
  max(churnRate) FILTER (WHERE tbl = 'payment' AND label = '3-5 Late') AS late35_rate,
  max(count) FILTER (WHERE tbl = 'nps' AND label = 'Detractor') AS detractor_count,
  max(count) FILTER (WHERE tbl = 'nps' AND label = 'Promoter') AS promoter_count,
  max(count) FILTER (WHERE tbl = 'contract' AND label = 'Monthly') AS monthly_count FROM li)"""


def kpis_cte() -> str:
    return f"""kp AS (SELECT (SELECT count(*) FROM train) + (SELECT count(*) FROM test) AS totalCustomers,
  (SELECT {rate()} FROM train) AS overallChurnRate,
  (SELECT round_even(avg(estimated_clv_usd), 0) FROM train) AS _avg,
  (SELECT CAST(coalesce(sum(churn_prediction), 0) AS BIGINT) FROM scores) AS highRiskCount),
kpis AS (SELECT totalCustomers, overallChurnRate, CAST(_avg AS BIGINT) AS avgClv, highRiskCount,
  CAST(round_even(highRiskCount * _avg, 0) AS BIGINT) AS revenueAtRisk FROM kp)"""


def unpivot(row_cte: str, items: list[tuple[str, dict[str, str]]], key: str = "column") -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS {q(key)}, " + ", ".join(f"{e} AS {q(s)}" for s, e in stats.items()) + f" FROM {row_cte}"
        for k, stats in items)


W = base_ctes()
WF = with_features()

# ------------------------------------------------------------ 2.1 / 2.2 / 2.3
oracle("j5_customer_table", f"WITH {W} SELECT * FROM customers")
oracle("j5_bucketed_customers", f"WITH {W} SELECT * FROM customers")
oracle("io3_write_csv", f"WITH {W} SELECT * FROM customers")
oracle("io1_read_table", "SELECT * FROM customer")
oracle("pf1_select", f"WITH {W} SELECT customer_id, tenure_months, contract_type, churned FROM customers")
oracle("pf2_drop_leakage", f"WITH {W} SELECT * EXCLUDE (recommended_action) FROM customers")
oracle("pf3_select_by_dtype", f"WITH {W} SELECT {', '.join(STRING_COLS)} FROM customers")
oracle("pf4_exclude_projection",
       f"WITH {W} SELECT * EXCLUDE (customer_id, churned, recommended_action, churned_observed, split) FROM train")
oracle("pf5_rename", f"WITH {W} SELECT * EXCLUDE (customer_id, churned), customer_id AS id, churned AS label FROM customers")
oracle("pf6_filter_counts", f"""WITH {W} SELECT count(*) FILTER (WHERE nps_score < 0) AS nps_negative,
  count(*) FILTER (WHERE tenure_months <= 6) AS tenure_le_6,
  count(*) FILTER (WHERE tenure_months >= 12 AND tenure_months < 24) AS tenure_12_24,
  count(*) FILTER (WHERE email_open_rate < 0 OR email_open_rate > 1) AS rate_out_of_range FROM customers""")
oracle("pf7_or_and_filter", f"""WITH {W} SELECT customer_id FROM customers
  WHERE (late_payments_last_12m >= 2 OR support_tickets_last_90d >= 3) AND contract_type = 'Monthly'""")
oracle("pf8_membership", f"""WITH {W} SELECT split, count(*) AS n FROM customers
  WHERE contract_type IN ('Monthly', 'Quarterly') GROUP BY split""")
oracle("pf9_search", f"""WITH {W}, {directory_cte()} SELECT * FROM dir
  WHERE contains(lower(id), 'monitor') OR contains(lower(status), 'monitor')""")
oracle("pf10_add_missing_columns", f"WITH {WF}, {enc_cte()} SELECT * FROM enc_test")
oracle("j1_predictions_join", f"""WITH {W}, {scores_cte()}
SELECT s.*, t.tenure_months, t.estimated_clv_usd FROM scores s JOIN test t ON s.customer_id = t.customer_id""")


def _long_distinct(src: str, cols: list[str]) -> str:
    return " UNION ".join(f"SELECT DISTINCT '{c}' AS {q('column')}, CAST({c} AS VARCHAR) AS value FROM {src} "
                          f"WHERE {c} IS NOT NULL" for c in cols)


oracle("j3_unseen_categories", f"""WITH {WF}
SELECT * FROM ({_long_distinct('test_feat', [*CATEGORICAL_FEATURES, 'days_since_last_purchase'])})
EXCEPT SELECT * FROM ({_long_distinct('train_feat', [*CATEGORICAL_FEATURES, 'days_since_last_purchase'])})""")

# --------------------------------------------------------------- 2.4 aggregates
oracle("ag1_shape", f"WITH {W} SELECT count(*) AS {q('rows')}, {len(CUST_TYPES)} AS columns FROM train")
oracle("ag2_column_profile", f"WITH {W} " + " UNION ALL ".join(
    f"SELECT '{c}' AS {q('column')}, '{t}' AS dtype, count(DISTINCT {c}) AS n_unique FROM train"
    for c, t in CUST_TYPES.items()))
oracle("ag2_sketch_profile", f"WITH {W} " + " UNION ALL ".join(
    f"SELECT '{c}' AS {q('column')}, count(DISTINCT {c}) AS n_unique, count(*) AS rows, count(*) - count({c}) AS missing, true AS within_error FROM customers"
    for c in [*CUST_TYPES, *(c for c in ("churned_observed", "split") if c not in CUST_TYPES)]))
oracle("ag3_target_distribution", f"""WITH {W} SELECT churned AS value, count(*) AS count,
  round_even(count(*) * 100.0E0 / sum(count(*)) OVER (), 6) AS pct FROM train GROUP BY churned""")
oracle("ag4_imbalance_ratio", f"""WITH {W} SELECT round_even(CAST(count(*) FILTER (WHERE churned = 0) AS DOUBLE)
  / nullif(count(*) FILTER (WHERE churned = 1), 0), 6) AS imbalance_ratio FROM train""")


def _missing(c: str) -> str:
    return f"{c} IS NULL OR isnan({c})" if CUST_TYPES[c] == "double" else f"{c} IS NULL"


oracle("ag5_missing_values", f"""WITH {W}, mrow AS (SELECT count(*) AS n, {', '.join(
    f'count(*) FILTER (WHERE {_missing(c)}) AS m{i}' for i, c in enumerate(CUST_TYPES))} FROM customers)
""" + unpivot("mrow", [(c, {"missing": f"m{i}", "pct": f"round_even(m{i} * 100.0E0 / nullif(n, 0), 6)"})
                       for i, c in enumerate(CUST_TYPES)]))
oracle("ag6_duplicate_rows", f"""WITH {W} SELECT (SELECT count(*) FROM customers)
  - (SELECT count(*) FROM (SELECT DISTINCT * FROM customers)) AS duplicate_rows""")
oracle("ag7_duplicate_ids", f"""WITH {W} SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_ids
  FROM (SELECT customer_id, count(*) AS c FROM customers GROUP BY customer_id)""")
oracle("ag8_negative_values", f"""WITH {W}, nrow AS (SELECT {', '.join(
    f'count(*) FILTER (WHERE {c} < 0) AS n{i}, CAST(min({c}) AS DOUBLE) AS m{i}' for i, c in enumerate(NON_NEGATIVE))}
  FROM train) """ + unpivot("nrow", [(c, {"negatives": f"n{i}", "min_value": f"m{i}"}) for i, c in enumerate(NON_NEGATIVE)]))
_B = [("nps_score", -100, 100)] + [(r, 0, 1) for r in RATE_COLS]
oracle("ag9_range_check", f"""WITH {W}, rrow AS (SELECT {', '.join(
    f'count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS o{i}, CAST(min({c}) AS DOUBLE) AS a{i}, '
    f'CAST(max({c}) AS DOUBLE) AS b{i}' for i, (c, lo, hi) in enumerate(_B))} FROM train) """ + unpivot(
    "rrow", [(c, {"out_of_range": f"o{i}", "min_value": f"a{i}", "max_value": f"b{i}"}) for i, (c, _, _) in enumerate(_B)]))
_INTS = [c for c in INT_COLS if c != "churned"]
oracle("ag10_int_ranges", f"""WITH {W}, irow AS (SELECT {', '.join(
    f'min({c}) AS a{i}, max({c}) AS b{i}' for i, c in enumerate(_INTS))} FROM train) """ + unpivot(
    "irow", [(c, {"min_value": f"CAST(a{i} AS BIGINT)", "max_value": f"CAST(b{i} AS BIGINT)",
                  "compact": f"a{i} >= 0 AND b{i} <= 255"}) for i, c in enumerate(_INTS)]))
_NUMS = [c for c in NUMERIC_COLS if c != "churned"]
oracle("ag11_iqr_outliers", f"""WITH {W},
qrow AS (SELECT count(*) AS n, {', '.join(f'quantile_cont({c}, 0.25) AS q1_{i}, quantile_cont({c}, 0.75) AS q3_{i}'
                                          for i, c in enumerate(_NUMS))} FROM train),
brow AS (SELECT n, {', '.join(f'q1_{i} - 1.5E0 * (q3_{i} - q1_{i}) AS lo{i}, q3_{i} + 1.5E0 * (q3_{i} - q1_{i}) AS hi{i}'
                              for i in range(len(_NUMS)))} FROM qrow),
crow AS (SELECT b.*, {', '.join(f'(SELECT count(*) FROM train WHERE {c} < b.lo{i} OR {c} > b.hi{i}) AS c{i}'
                               for i, c in enumerate(_NUMS))} FROM brow b),
lng AS ({unpivot('crow', [(c, {'count': f'c{i}', 'pct': f'round_even(c{i} * 100.0E0 / nullif(n, 0), 6)',
                              'lower': f'round_even(lo{i}, 6)', 'upper': f'round_even(hi{i}, 6)'})
                          for i, c in enumerate(_NUMS)])})
SELECT * FROM lng WHERE count > 0""")
oracle("ag12_leakage_by_category", f"""WITH {W} SELECT recommended_action AS category,
  round_even(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate, avg(CAST(churned AS DOUBLE)) IN (0.0, 1.0) AS is_pure
  FROM train WHERE recommended_action IS NOT NULL GROUP BY recommended_action""")
_LEAK = [c for c in STRING_COLS if c not in ("customer_id", "split")]
oracle("ag12_leakage_scan", f"""WITH {W}, per AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS {q('column')}, avg(CAST(churned AS DOUBLE)) AS r FROM train WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in _LEAK) + f""") SELECT {q('column')}, count(*) AS n_categories, bool_and(r IN (0.0, 1.0)) AS leaks
  FROM per GROUP BY {q('column')}""")
_BANDS = """bands AS (SELECT * FROM (VALUES (0, 'High Risk', '#f43f5e'), (1, 'Medium Risk', '#38bdf8'),
  (2, 'Low Risk', '#8b5cf6')) t(band_order, name, color))"""
oracle("ag13_risk_segments", f"""WITH {W}, {scores_cte()}, {_BANDS},
cnt AS (SELECT CASE WHEN churn_probability >= 0.7 THEN 'High Risk' WHEN churn_probability >= 0.3 THEN 'Medium Risk'
  WHEN churn_probability < 0.3 THEN 'Low Risk' END AS name, count(*) AS value FROM scores GROUP BY 1)
SELECT b.name, CAST(coalesce(c.value, 0) AS BIGINT) AS value, b.color FROM bands b LEFT JOIN cnt c ON b.name = c.name""")
oracle("ag13_risk_segments_fallback", f"""WITH {W}, {scores_cte()}, {_BANDS},
t AS (SELECT count(*) AS n, CAST(sum(churn_prediction) AS BIGINT) AS pos FROM scores),
v AS (SELECT pos AS h, CAST(round_even(n * 0.15E0, 0) AS BIGINT) AS m, n - pos - CAST(round_even(n * 0.15E0, 0) AS BIGINT) AS l FROM t)
SELECT b.name, CASE b.band_order WHEN 0 THEN v.h WHEN 1 THEN v.m ELSE v.l END AS value, b.color FROM bands b CROSS JOIN v""")


def pearson_sql(x: str, y: str) -> str:
    xd, yd = f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
    return (f"covar_samp({xd}, {yd}) / nullif(stddev_samp(CASE WHEN {y} IS NOT NULL THEN {xd} END) * "
            f"stddev_samp(CASE WHEN {x} IS NOT NULL THEN {yd} END), 0)")


oracle("ag14_target_correlation", f"WITH {W} SELECT round_even({pearson_sql('estimated_clv_usd', 'churned')}, 6) AS r FROM train")
_FNUMS = [c for c in list(CUST_TYPES) + NEW_FEATURES if FEAT_TYPES.get(c) in ("int", "double") and c != "churned"]


def _corr_target(limit: int) -> str:
    return f"""WITH {WF}, crow AS (SELECT {', '.join(f'{pearson_sql(c, "churned")} AS r{i}' for i, c in enumerate(_FNUMS))}
  FROM train_feat),
lng AS ({unpivot('crow', [(c, {'r': f'round_even(r{i}, 6)'}) for i, c in enumerate(_FNUMS)], 'feature')})
SELECT feature, r, CASE WHEN r > 0 THEN 'up' ELSE 'down' END AS direction FROM lng WHERE r IS NOT NULL
ORDER BY abs(r) DESC, feature LIMIT {limit}"""


oracle("ag15_correlation_with_target", _corr_target(15))
oracle("s2_sort_abs", f"SELECT *, row_number() OVER (ORDER BY abs(r) DESC, feature) AS position FROM ({_corr_target(len(_FNUMS))})")
_PAIRS = [(a, b) for i, a in enumerate(ENC_FEATURES) for b in ENC_FEATURES[i + 1:]]
oracle("ag16_correlated_pairs", f"""WITH {WF}, {enc_cte()},
prow AS (SELECT {', '.join(f'corr({q(a)}, {q(b)}) AS p{k}' for k, (a, b) in enumerate(_PAIRS))} FROM enc_train),
lng AS (UNPIVOT prow ON {', '.join(f'p{k}' for k in range(len(_PAIRS)))} INTO NAME k VALUE r),
names AS (SELECT * FROM (VALUES {', '.join(f"('p{k}', '{a}', '{b}')" for k, (a, b) in enumerate(_PAIRS))}) t(k, feature_a, feature_b))
SELECT n.feature_a, n.feature_b, round_even(abs(l.r), 6) AS abs_r FROM lng l JOIN names n ON l.k = n.k
WHERE NOT isnan(l.r) AND abs(l.r) > 0.85 ORDER BY abs_r DESC, feature_a, feature_b LIMIT 10""")
_CBC = ["recency_bucket", "age_group", "tenure_category", "nps_category", "high_risk"]
oracle("ag17_churn_by_category", f"WITH {WF} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS category, round_even(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate, "
    f"count(*) AS count FROM train_feat WHERE {c} IS NOT NULL GROUP BY {c}" for c in _CBC))
oracle("ag18_feature_summary", f"WITH {WF} " + " UNION ALL ".join(
    (f"SELECT '{f}' AS feature, 'numeric' AS kind, CAST(NULL AS BIGINT) AS n_categories, "
     f"round_even(avg(CAST({f} AS DOUBLE)), 6) AS mean FROM train_feat") if f in NEW_NUMERIC_TYPES else
    (f"SELECT '{f}', 'categorical', count(DISTINCT {f}), CAST(NULL AS DOUBLE) FROM train_feat")
    for f in NEW_FEATURES))
oracle("ag19_data_dictionary", f"""WITH {WF}, {enc_cte()},
drow AS (SELECT {', '.join(f'CAST(min({q(f)}) AS DOUBLE) AS a{i}, CAST(max({q(f)}) AS DOUBLE) AS b{i}, '
                           f'avg(CAST({q(f)} AS DOUBLE)) AS m{i}, stddev_samp(CAST({q(f)} AS DOUBLE)) AS s{i}'
                           for i, f in enumerate(ENC_FEATURES))} FROM enc_train)
""" + unpivot("drow", [(f, {"dtype": f"'{ENC_TYPES[f]}'", "min": f"a{i}", "max": f"b{i}", "mean": f"round_even(m{i}, 6)",
                            "std": f"round_even(s{i}, 6)"}) for i, f in enumerate(ENC_FEATURES)], "feature"))
oracle("ag20_kpis", f"WITH {W}, {scores_cte()}, {kpis_cte()} SELECT * FROM kpis")


def _grouped(src: str, key_sql: str, name: str, with_count: bool = True) -> str:
    cnt = ", count(*) AS count" if with_count else ""
    return (f"SELECT b AS {name}, {rate()} AS churnRate{cnt} FROM (SELECT {key_sql} AS b, churned FROM {src}) "
            f"WHERE b IS NOT NULL GROUP BY b")


oracle("ag21_tenure_impact", f"WITH {W} " + _grouped(
    "train", cut_sql("tenure_months", TENURE_IMPACT_EDGES, TENURE_IMPACT_LABELS, right=False), "tenure"))
_ENG = ["Very Low", "Low", "Medium", "High", "Very High"]
oracle("ag22_engagement_impact", f"""WITH {WF},
e AS (SELECT quantile_cont(engagement_score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM train_feat)
SELECT b AS engagement, {rate()} AS churnRate FROM (SELECT CASE {' '.join(
    f"WHEN engagement_score <= q[{i + 2}] THEN '{lab}'" for i, lab in enumerate(_ENG))} END AS b, churned
  FROM train_feat CROSS JOIN e WHERE engagement_score IS NOT NULL) WHERE b IS NOT NULL GROUP BY b""")
oracle("ag22_engagement_impact_merge", f"""WITH {WF},
e AS (SELECT list_distinct(quantile_cont(engagement_score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS q0 FROM train_feat),
e2 AS (SELECT list_sort(q0) AS q FROM e)
SELECT b AS engagement, {rate()} AS churnRate FROM (SELECT CASE {' '.join(
    f"WHEN {i + 1} < len(q) AND engagement_score <= q[{i + 2}] THEN '{lab}'" for i, lab in enumerate(_ENG))} END AS b, churned
  FROM train_feat CROSS JOIN e2 WHERE engagement_score IS NOT NULL) WHERE b IS NOT NULL GROUP BY b""")
oracle("ag23_clv_segments", f"WITH {W} " + _grouped("train", "clv_segment", "segment", False))
oracle("ag24_contract_stats", f"WITH {W} " + _grouped("train", "contract_type", "contract"))
oracle("ag25_nps_stats", f"WITH {WF} " + _grouped("train_feat", "nps_category", "category"))
oracle("ag26_payment_stats", f"WITH {W} " + _grouped(
    "train", cut_sql("late_payments_last_12m", PAYMENT_EDGES, PAYMENT_LABELS, right=True), "group"))
oracle("ag27_class_distribution", f"""WITH {W} SELECT count(*) FILTER (WHERE churned = 0) AS not_churned,
  count(*) FILTER (WHERE churned = 1) AS churned,
  round_even(count(*) FILTER (WHERE churned = 1) * 1.0E0 / nullif(count(*), 0), 6) AS churn_rate FROM train""")
oracle("ag28_class_weights", f"""WITH {W}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE churned = 0) AS n0,
  count(*) FILTER (WHERE churned = 1) AS n1 FROM train)
SELECT round_even(n0 * 1.0E0 / nullif(n1, 0), 6) AS pos_weight, round_even(n * 1.0E0 / nullif(n0 * 2, 0), 6) AS weight_0,
  round_even(n * 1.0E0 / nullif(n1 * 2, 0), 6) AS weight_1 FROM c""")
oracle("ag29_prediction_totals", f"""WITH {W}, {scores_cte()} SELECT count(*) AS total,
  CAST(sum(churn_prediction) AS BIGINT) AS predicted_churned,
  round_even(avg(CAST(churn_prediction AS DOUBLE)), 6) AS predicted_churn_rate FROM scores""")
_RAW_CATEGORICAL = ["gender", "city_tier", "subscription_type", "contract_type", "marketing_channel", "clv_segment"]
oracle("ag30_distinct_categories", f"WITH {W} " + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column, {c} AS value FROM train WHERE {c} IS NOT NULL" for c in _RAW_CATEGORICAL))

# ------------------------------------------------------ 2.5 / 2.6 windows, sorts
_IMP = f"WITH {WF}, {enc_cte()}, {importance_cte()}"
oracle("w1_average_rank", f"{_IMP} SELECT feature, imp_a, rank_a, imp_b, rank_b FROM combined")
oracle("w2_top_features", f"""{_IMP} SELECT feature, imp_a, row_number() OVER (ORDER BY imp_a DESC, feature) AS rank
  FROM combined ORDER BY imp_a DESC, feature LIMIT 10""")
oracle("j2_importance_join", f"{_IMP} SELECT feature, imp_a, imp_b FROM combined")
oracle("ml16_combined_importance", f"{_IMP} SELECT * FROM combined ORDER BY avg_rank, feature")
_READABLE = "replace(replace(feature, '_', ' '), 'tenure category Loyal (4y+)', 'tenure(Loyal 4y+)')"
_DRIVERS = f"""drivers AS (SELECT row_number() OVER (ORDER BY avg_rank, feature) AS position, {_READABLE} AS feature,
  round((coalesce(imp_a, 0.0E0) + coalesce(imp_b, 0.0E0)) / 2.0E0, 4) AS importance
  FROM (SELECT * FROM combined ORDER BY avg_rank, feature LIMIT 10))"""
oracle("sv6_churn_drivers", f"{_IMP}, {_DRIVERS} SELECT * FROM drivers")
oracle("sv7_driver_percent", f"""{_IMP}, {_DRIVERS} SELECT position, replace(feature, '_', ' ') AS name,
  CAST(round(importance * 100.0E0, 0) AS BIGINT) AS importance FROM drivers ORDER BY position LIMIT 8""")
oracle("s1_sort_desc", f"""WITH {W}, {scores_cte()} SELECT *,
  row_number() OVER (ORDER BY churn_probability DESC, customer_id) AS position FROM scores""")
oracle("s3_custom_order", f"""WITH {W}, g AS ({_grouped("train", "clv_segment", "segment", False)})
SELECT *, row_number() OVER (ORDER BY CASE segment WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3
  WHEN 'Platinum' THEN 4 ELSE 9 END, segment) AS position FROM g""")
oracle("s4_topk", f"""WITH {W} SELECT customer_id, estimated_clv_usd,
  row_number() OVER (ORDER BY estimated_clv_usd DESC, customer_id) AS rank FROM customers
  ORDER BY estimated_clv_usd DESC, customer_id LIMIT 20""")
oracle("s5_argmax", f"WITH {W}, {ranked_cte()} SELECT model, f1 FROM ranked ORDER BY f1 DESC, model LIMIT 1")
oracle("s6_keyset_page", f"WITH {W}, {directory_cte()} SELECT * FROM dir ORDER BY churn_probability DESC, id LIMIT 15 OFFSET 15")

# ------------------------------------------------------------------ 2.7 set ops
oracle("so1_id_overlap", f"""WITH {W} SELECT count(*) AS overlapping_ids FROM
  (SELECT customer_id FROM train INTERSECT SELECT customer_id FROM test)""")
_RAWCAT = ["gender", "city_tier", "subscription_type", "contract_type", "marketing_channel", "clv_segment"]
oracle("so2_unseen_categories", f"""WITH {W} SELECT * FROM ({_long_distinct('test', [*_RAWCAT, 'days_since_last_purchase'])})
EXCEPT SELECT * FROM ({_long_distinct('train', [*_RAWCAT, 'days_since_last_purchase'])})""")
oracle("so3_schema_alignment", f"""WITH {WF}, tr AS ({_long_distinct('train_feat', CATEGORICAL_FEATURES)}),
te AS ({_long_distinct('test_feat', CATEGORICAL_FEATURES)})
SELECT {q('column')} || '_' || value AS {q('column')}, 'missing_in_test' AS status FROM (SELECT * FROM tr EXCEPT SELECT * FROM te)
UNION ALL
SELECT {q('column')} || '_' || value, 'extra_in_test' FROM (SELECT * FROM te EXCEPT SELECT * FROM tr)""")
oracle("so4_population_total", f"""WITH {W} SELECT count(*) AS total_customers FROM
  (SELECT customer_id FROM train UNION ALL SELECT customer_id FROM test)""")

# ------------------------------------------------------------ 2.8 scalar
_SC = {
    "sc1_gender": "regexp_replace(' ' || chr(9) || gender || chr(10) || ' ', '^\\s+|\\s+$', '', 'g')",
    "sc2_contains": "contains(lower(customer_id), '10')",
    "sc3_replaced": "replace(marketing_channel, ' ', '_')",
    "sc4_nps_clipped": "CASE WHEN nps_score IS NULL THEN NULL ELSE least(greatest(nps_score, 0), 50) END",
    "sc5_ratio": "support_tickets_last_90d / nullif(late_payments_last_12m, 0)",
    "sc6_flag": "CAST(coalesce(days_since_last_purchase >= 60, false) AS INT)",
    "sc7_logit": "round_even(ln(churn_probability / (1.0E0 - churn_probability)), 6)",
    "sc8_clv_even": "round_even(estimated_clv_usd, 0)",
    "sc9_pct_up": "round(churn_probability * 100.0E0, 0)",
    "sc9_pct_fixed": "printf('%.1f', round(churn_probability * 100.0E0, 1))",
    "sc10_mod": "CAST(trunc(estimated_clv_usd) AS INT) % 14",
    "sc11_band": "CASE WHEN nps_score > 50 THEN 'high' WHEN nps_score > 0 THEN 'mid' ELSE 'low' END",
    "sc12_months": "CASE contract_type WHEN 'Monthly' THEN 1 WHEN 'Quarterly' THEN 3 WHEN 'Annual' THEN 12 END",
    "sc13_days": "coalesce(days_since_last_purchase, -1)",
    "sc14_max_abs": "greatest(abs(nps_score), tenure_months)",
    "sc15_label": "printf('%s-%d', contract_type, tenure_months)",
}
_OF_CUSTOMERS = {"sc1_gender", "sc3_replaced", "sc4_nps_clipped", "sc5_ratio", "sc6_flag", "sc8_clv_even", "sc12_months", "sc14_max_abs"}
for _k, _e in _SC.items():
    oracle(_k, f"WITH {W} SELECT customer_id, {_e} AS {_k} FROM customers" if _k in _OF_CUSTOMERS else
           f"""WITH {W}, {scores_cte()} SELECT customer_id, {_e} AS {_k}
  FROM test t JOIN scores s USING (customer_id)""")

# ------------------------------------------------------------ 2.9 features
oracle("fe21_feature_table", f"WITH {WF} SELECT * FROM train_feat UNION ALL SELECT * FROM test_feat")
oracle("fe21_features_train_stats", f"WITH {with_features('train')} SELECT * FROM train_feat UNION ALL SELECT * FROM test_feat")
oracle("fe7_payment_reliability_train_stats",
       f"WITH {with_features('train')} SELECT customer_id, payment_reliability, nps_category FROM test_feat")
_REC = cut_sql("days_since_last_purchase", RECENCY_EDGES, RECENCY_LABELS)
oracle("fe1_cut", f"WITH {W} SELECT customer_id, {_REC} AS bucket, coalesce({_REC}, 'nan') AS bucket_parity FROM customers")
oracle("fe2_quantile_cut", f"""WITH {W}, st AS (SELECT quantile_cont(nps_score, 0.33) AS q0, quantile_cont(nps_score, 0.66) AS q1 FROM train)
SELECT customer_id, nps_score, CASE WHEN nps_score <= q0 THEN 'Detractor' WHEN nps_score <= q1 THEN 'Passive'
  WHEN nps_score IS NOT NULL THEN 'Promoter' END AS nps_category FROM train CROSS JOIN st""")
oracle("fe3_qcut", f"""WITH {W}, e AS (SELECT quantile_cont(tenure_months, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM train)
SELECT customer_id, tenure_months, CASE WHEN tenure_months <= q[2] THEN 'q1' WHEN tenure_months <= q[3] THEN 'q2'
  WHEN tenure_months <= q[4] THEN 'q3' WHEN tenure_months <= q[5] THEN 'q4' END AS tenure_quartile FROM train CROSS JOIN e""")
oracle("fe17_one_hot", f"WITH {WF}, {enc_cte()} SELECT * FROM enc_train")
oracle("fe18_align_to_train", f"WITH {WF}, {enc_cte()} SELECT * FROM enc_test")
_STD = list(ENC_FEATURES)
oracle("fe20_standardize", f"""WITH {WF}, {enc_cte()},
st AS (SELECT {', '.join(f'avg({q(c)}) AS m{i}, stddev_pop({q(c)}) AS s{i}' for i, c in enumerate(_STD))} FROM enc_train)
SELECT customer_id, {', '.join(f'round_even(({q(c)} - m{i}) / CASE WHEN s{i} = 0 OR s{i} IS NULL THEN 1.0E0 ELSE s{i} END, 6) AS {q(c)}'
                               for i, c in enumerate(_STD))} FROM enc_test CROSS JOIN st""")

# ---------------------------------------------------- 2.10 deterministic model ops
_H = "CAST(('0x' || substr(md5(customer_id || ':42'), 1, 8)) AS UBIGINT)"
oracle("ml2_stratified_folds", f"WITH {W} SELECT customer_id, churned, CAST({_H} % 5 AS INT) AS fold FROM train")
oracle("ml2_stratified_folds_exact", f"""WITH {W} SELECT customer_id, churned,
  CAST((row_number() OVER (PARTITION BY churned ORDER BY {_H}, customer_id) - 1) % 5 AS INT) AS fold FROM train""")
oracle("ml12_holdout_split", f"WITH {W} SELECT customer_id, churned, {_H} < {int(round(0.2 * (1 << 32)))} AS is_holdout FROM train")
oracle("ml12_holdout_split_exact", f"""WITH {W} SELECT customer_id, churned,
  row_number() OVER (PARTITION BY churned ORDER BY {_H}, customer_id) - 1
    < round_even(count(*) OVER (PARTITION BY churned) * 0.2E0, 0) AS is_holdout FROM train""")
_TS = f"""{scores_cte()}, ts AS (SELECT s.*, t.churned AS label FROM scores s JOIN test t ON s.customer_id = t.customer_id),
cm AS (SELECT count(*) FILTER (WHERE label = 0 AND churn_prediction = 0) AS tn,
  count(*) FILTER (WHERE label = 0 AND churn_prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND churn_prediction = 0) AS fn,
  count(*) FILTER (WHERE label = 1 AND churn_prediction = 1) AS tp FROM ts)"""


def _prf_sql(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    return (f"coalesce({tp} * 1.0E0 / nullif({tp} + {fp}, 0), 0.0E0)", f"coalesce({tp} * 1.0E0 / nullif({tp} + {fn}, 0), 0.0E0)",
            f"coalesce(2.0E0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0E0)")


_p1, _r1, _f1 = _prf_sql("tp", "fp", "fn")
_p0, _r0, _f0 = _prf_sql("tn", "fn", "fp")
oracle("ml13_classification_report", f"""WITH {W}, {_TS},
x AS (SELECT *, tn + fp AS s0, tp + fn AS s1, tn + fp + tp + fn AS n, {_p0} AS p0, {_r0} AS r0, {_f0} AS f0,
  {_p1} AS p1, {_r1} AS r1, {_f1} AS f1 FROM cm)
SELECT '0' AS class, round_even(p0, 6) AS precision, round_even(r0, 6) AS recall, round_even(f0, 6) AS f1, s0 AS support FROM x
UNION ALL SELECT '1', round_even(p1, 6), round_even(r1, 6), round_even(f1, 6), s1 FROM x
UNION ALL SELECT 'accuracy', NULL, NULL, round_even((tp + tn) * 1.0E0 / nullif(n, 0), 6), n FROM x
UNION ALL SELECT 'macro avg', round_even((p0 + p1) / 2, 6), round_even((r0 + r1) / 2, 6), round_even((f0 + f1) / 2, 6), n FROM x
UNION ALL SELECT 'weighted avg', round_even((p0 * s0 + p1 * s1) / nullif(n, 0), 6), round_even((r0 * s0 + r1 * s1) / nullif(n, 0), 6),
  round_even((f0 * s0 + f1 * s1) / nullif(n, 0), 6), n FROM x""")
oracle("ml13_confusion_matrix", f"""WITH {W}, {_TS}, n AS (SELECT tn + fp + fn + tp AS n, * FROM cm)
SELECT 0 AS actual, 0 AS predicted, tn AS count, round_even(tn * 100.0E0 / nullif(n, 0), 6) AS pct FROM n
UNION ALL SELECT 0, 1, fp, round_even(fp * 100.0E0 / nullif(n, 0), 6) FROM n
UNION ALL SELECT 1, 0, fn, round_even(fn * 100.0E0 / nullif(n, 0), 6) FROM n
UNION ALL SELECT 1, 1, tp, round_even(tp * 100.0E0 / nullif(n, 0), 6) FROM n""")
oracle("ml14_roc_auc", f"""WITH {W}, {_TS},
d AS (SELECT churn_probability AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM ts GROUP BY 1),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d)
SELECT round_even(sum(pos * (below + neg / 2.0E0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c""")
oracle("ml14_roc_auc_by_fold", f"""WITH {W}, {scorers_cte('train', 'sc')},
f AS (SELECT *, CAST({_H} % 5 AS INT) AS fold FROM sc),
d AS (SELECT fold, p_c AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM f GROUP BY 1, 2),
c AS (SELECT fold, pos, neg, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d)
SELECT fold, round_even(sum(pos * (below + neg / 2.0E0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c GROUP BY fold""")
oracle("ml8_soft_vote", f"""WITH {W}, {scorers_cte('test', 'sc')}
SELECT customer_id, round_even((p_a + p_b + p_c) / 3.0E0, 6) AS vote_probability,
  CAST((p_a + p_b + p_c) / 3.0E0 >= 0.5 AS INT) AS vote_prediction FROM sc""")
oracle("ml10_rank_models", f"WITH {W}, {ranked_cte()} SELECT * FROM ranked")
oracle("ml20_model_performance", f"""WITH {W}, {ranked_cte()} SELECT round_even(f1 * 100.0E0, 1) AS f1,
  round_even(precision * 100.0E0, 1) AS precision, round_even(recall * 100.0E0, 1) AS recall,
  round_even(roc_auc * 100.0E0, 1) AS roc_auc, round_even(accuracy * 100.0E0, 1) AS accuracy, model AS champion_model
  FROM ranked WHERE is_champion""")
_ACTIONS = ", ".join(f"'{a}'" for a in CHURN_ACTIONS)
oracle("ml18_rule_score", f"""WITH {W} SELECT customer_id,
  CAST(coalesce(recommended_action IN ({_ACTIONS}), false) AS INT) AS churn_prediction FROM test""")
oracle("ml18_rule_score_summary", f"""WITH {W}, r AS (SELECT CAST(coalesce(recommended_action IN ({_ACTIONS}), false) AS INT) AS p FROM test)
SELECT count(*) AS total, CAST(sum(p) AS BIGINT) AS predicted_churned, round_even(avg(CAST(p AS DOUBLE)), 6) AS predicted_churn_rate FROM r""")

# ------------------------------------------------------------ 2.11 serving
_SOFT = ("round_even((1.0E0 / (1.0E0 + exp(-(ln(least(greatest(churn_probability, 0.001), 0.999) / "
         "(1.0E0 - least(greatest(churn_probability, 0.001), 0.999))) / 2.5E0))) * 100.0E0), 6)")
oracle("sv1_soften", f"WITH {W}, {scores_cte()} SELECT customer_id, {_SOFT} AS soft_score FROM scores")
oracle("sv2_customer_directory", f"WITH {W}, {directory_cte()} SELECT * FROM dir ORDER BY churn_probability DESC, id")
oracle("sv3_search_customers", f"""WITH {W}, {directory_cte()} SELECT * FROM dir
  WHERE (contains(lower(id), '10') OR contains(lower(status), '10')) AND status = 'Monitoring'""")
oracle("sv4_page_customers", f"WITH {W}, {directory_cte()} SELECT * FROM dir ORDER BY churn_probability DESC, id LIMIT 15")
_HIT = "(contains(lower(id), {q}) OR contains(lower(status), {q}))"
oracle("sv3_indexed_search", f"WITH {W}, {directory_cte()} " + " UNION ALL ".join(
    f"SELECT *, '{t}' AS term FROM dir WHERE " + _HIT.format(q=f"'{t.lower()}'") + ("" if s == "All" else f" AND status = '{s}'")
    for t, s in [("T1001", "All"), ("monitor", "All"), ("7", "Healthy"), ("ust10", "At Risk"), ("q-none", "All")]))
oracle("sv4_stored_pages", f"""WITH {W}, {directory_cte()}, n AS (SELECT *, row_number() OVER (ORDER BY churn_probability DESC, id) - 1 AS k FROM dir)
SELECT * EXCLUDE (k), CAST(k // 15 AS INT) AS page FROM n WHERE k // 15 IN (0, 1, 7)""")
oracle("s6_stored_keyset_page", f"""WITH {W}, {directory_cte()} SELECT * FROM dir
  WHERE churn_probability < 0.5 OR (churn_probability = 0.5 AND id > 'CUST100500') ORDER BY churn_probability DESC, id LIMIT 15""")
oracle("sv11_document_directory", f"WITH {W}, {directory_cte()} SELECT * FROM dir")
oracle("sv5_risk_band", f"""WITH {W}, {directory_cte()} SELECT id, riskScore,
  CASE WHEN riskScore > 75 THEN '#f43f5e' WHEN riskScore > 35 THEN '#f59e0b' ELSE '#34d399' END AS colour FROM dir""")
_LEVERS = """lv AS (SELECT * FROM (VALUES ('clv-optimization', 'clv', 'Low', 'High'), ('early-tenure', 'tenure', 'New (<6m)', 'Loyal (4y+)'),
  ('contract-annual', 'contract', 'Monthly', 'Annual'), ('payment-grace', 'payment', '3-5 Late', '0 Late'),
  ('nps-improvement', 'nps', 'Detractor', 'Promoter')) t(lever, tbl, label_a, label_b))"""
oracle("sv8_retention_levers", f"""WITH {WF}, {lever_cte()}, {_LEVERS}
SELECT lv.lever, lv.label_a, a.churnRate AS rate_a, a.count AS count_a, lv.label_b, b.churnRate AS rate_b, b.count AS count_b,
  round_even(a.churnRate - b.churnRate, 1) AS gap
FROM lv LEFT JOIN li a ON a.tbl = lv.tbl AND a.label = lv.label_a LEFT JOIN li b ON b.tbl = lv.tbl AND b.label = lv.label_b""")
oracle("sv10_insight_gaps", f"""WITH {WF}, {lever_cte()}
SELECT 'monthly_vs_annual_gap' AS metric, round_even(monthly_rate - annual_rate, 1) AS value FROM rr
UNION ALL SELECT 'detractor_vs_promoter_gap', round_even(detractor_rate - promoter_rate, 1) FROM rr
UNION ALL SELECT 'low_clv_rate', low_clv_rate FROM rr UNION ALL SELECT 'medium_clv_rate', medium_clv_rate FROM rr
UNION ALL SELECT 'high_clv_rate', high_clv_rate FROM rr UNION ALL SELECT 'late0_rate', late0_rate FROM rr
UNION ALL SELECT 'late35_rate', late35_rate FROM rr""")
oracle("sv9_campaign_sizing", f"""WITH {WF}, {scores_cte()}, {kpis_cte()}, {lever_cte()}, x AS (SELECT * FROM kpis CROSS JOIN rr)
SELECT 'targeted-retention' AS campaign, CAST(highRiskCount AS BIGINT) AS segment_size, CAST(revenueAtRisk AS DOUBLE) AS value,
  'usd_at_risk' AS unit FROM x
UNION ALL SELECT 'nps-detractor-outreach', CAST(detractor_count AS BIGINT), round(detractor_count * avgClv * 0.12E0, 0), 'usd_recovered' FROM x
UNION ALL SELECT 'monthly-to-annual', CAST(monthly_count AS BIGINT), round(monthly_rate - annual_rate, 1), 'churn_points' FROM x""")

oracle("io5_source_or_fallback", f"""SELECT *, 'table' AS source, 'written' AS asked FROM ({ORACLES["ag13_risk_segments"]})
UNION ALL SELECT *, 'fallback', 'missing' FROM ({ORACLES["ag13_risk_segments"]})""")
oracle("ml4_class_weighting", f"""WITH {W}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE churned = 0) AS n0,
  count(*) FILTER (WHERE churned = 1) AS n1 FROM train)
SELECT customer_id, churned, CASE WHEN churned = 1 THEN round_even(n * 1.0E0 / nullif(n1 * 2, 0), 6)
  ELSE round_even(n * 1.0E0 / nullif(n0 * 2, 0), 6) END AS weight FROM train CROSS JOIN c""")
oracle("so5_union_synthetic", f"""WITH {W}, c AS (SELECT count(*) FILTER (WHERE churned = 0) AS n0,
  count(*) FILTER (WHERE churned = 1) AS n1 FROM train)
SELECT 0 AS label, false AS is_synthetic, n0 AS n FROM c UNION ALL SELECT 1, false, n1 FROM c
UNION ALL SELECT CASE WHEN n1 < n0 THEN 1 ELSE 0 END, true, abs(n0 - n1) FROM c WHERE n0 <> n1""")


for _k, _c in FEATURE_IDS.items():
    oracle(_k, f"WITH {WF} SELECT customer_id, split, {_c} FROM train_feat UNION ALL "
               f"SELECT customer_id, split, {_c} FROM test_feat")
