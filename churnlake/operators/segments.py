"""Churn by segment and dashboard KPIs (AG13, AG17, AG20-AG26, AG28, AG29).

Each table is one ``groupBy`` with map-side partial aggregation: the shuffle
carries one row per (partition, segment), whatever the table size or skew.
Rates are reported the way the reference does (percent, 1 dp, half-even).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import cut, qcut
from ..functions.scalar import round_half_even
from ..sources.customers import TARGET_COL

# Fixed values (dashboard bucket definitions).
TENURE_IMPACT_EDGES = [0, 6, 12, 24, 48, 999]
TENURE_IMPACT_LABELS = ["New (<6m)", "Early (6-12m)", "Dev (1-2y)", "Estab (2-4y)", "Loyal (4y+)"]
PAYMENT_EDGES = [-1, 0, 2, 5, 999]
PAYMENT_LABELS = ["0 Late", "1-2 Late", "3-5 Late", "6+ Late"]
ENGAGEMENT_LABELS = ["Very Low", "Low", "Medium", "High", "Very High"]
CLV_ORDER = ["Low", "Medium", "High"]
NPS_ORDER = ["Detractor", "Passive", "Promoter"]
RISK_BANDS = [("High Risk", "#f43f5e"), ("Medium Risk", "#38bdf8"), ("Low Risk", "#8b5cf6")]
RISK_HIGH, RISK_LOW = 0.7, 0.3
FALLBACK_MEDIUM_SHARE = 0.15


def churn_rate_pct(target: str = TARGET_COL) -> Column:
    """mean(target) * 100 rounded to 1 dp, half-even (Python ``round``)."""
    return round_half_even(F.avg(F.col(target).cast("double")) * 100.0, 1)


def _order_col(c: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), c)


def grouped_rate(df: DataFrame, key: Column, key_name: str, with_count: bool = True,
                 order: Sequence[str] | None = None, target: str = TARGET_COL) -> DataFrame:
    """Shared shape of AG21-AG26: key, churnRate[, count]; NULL keys dropped
    (pandas groupby drops NaN keys, T9); sorted by ``order`` or by key."""
    aggs = [churn_rate_pct(target).alias("churnRate")]
    if with_count:
        aggs.append(F.count(F.lit(1)).alias("count"))
    g = df.select(key.alias(key_name), F.col(target)).filter(F.col(key_name).isNotNull()).groupBy(key_name).agg(*aggs)
    sort = _order_col(F.col(key_name), order) if order else F.col(key_name)
    return g.orderBy(sort)


def tenure_impact(train: DataFrame) -> DataFrame:
    """AG21: left-closed tenure buckets; empty buckets are absent."""
    key = cut("tenure_months", TENURE_IMPACT_EDGES, TENURE_IMPACT_LABELS, right=False)
    return grouped_rate(train, key, "tenure", order=TENURE_IMPACT_LABELS)


def engagement_impact(train_feat: DataFrame, on_duplicate: str = "raise") -> DataFrame:
    """AG22: equal-frequency quintiles of engagement_score (FE3)."""
    b = qcut(train_feat.select("engagement_score", TARGET_COL), "engagement_score", 5, ENGAGEMENT_LABELS,
             "engagement", on_duplicate=on_duplicate)
    return grouped_rate(b, F.col("engagement"), "engagement", with_count=False, order=ENGAGEMENT_LABELS)


def clv_segments(train: DataFrame) -> DataFrame:
    """AG23: order Low, Medium, High."""
    return grouped_rate(train, F.col("clv_segment"), "segment", with_count=False, order=CLV_ORDER)


def contract_stats(train: DataFrame) -> DataFrame:
    """AG24: contract, churnRate, count."""
    return grouped_rate(train, F.col("contract_type"), "contract")


def nps_stats(train_feat: DataFrame) -> DataFrame:
    """AG25: order Detractor, Passive, Promoter."""
    return grouped_rate(train_feat, F.col("nps_category"), "category", order=NPS_ORDER)


def payment_stats(train: DataFrame) -> DataFrame:
    """AG26: right-closed late-payment groups."""
    key = cut("late_payments_last_12m", PAYMENT_EDGES, PAYMENT_LABELS, right=True)
    return grouped_rate(train, key, "group", order=PAYMENT_LABELS)


def churn_by_category(train_feat: DataFrame, cols: Sequence[str], target: str = TARGET_COL) -> DataFrame:
    """AG17: feature, category, churn_rate, count for several columns in one
    pass (unpivot, then one grouped aggregate); rate descending per feature."""
    long = train_feat.select(F.col(target).cast("double").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in cols])).alias("kv")
    ).select("kv.feature", "kv.category", "_y").filter(F.col("category").isNotNull())
    g = long.groupBy("feature", "category").agg(F.bround(F.avg("_y"), 6).alias("churn_rate"),
                                                F.count(F.lit(1)).alias("count"))
    return g.orderBy("feature", F.desc("churn_rate"), "category")


def risk_segments(scores: DataFrame, prob_col: str = "churn_probability", pred_col: str = "churn_prediction") -> DataFrame:
    """AG13: High >= 0.7, Medium [0.3, 0.7), Low < 0.3; bands with zero rows
    are kept. Without a probability column: High = predicted positives,
    Medium = round(0.15 n) (half-even), Low = the rest."""
    spark = scores.sparkSession
    bands = spark.createDataFrame([(i, n, col) for i, (n, col) in enumerate(RISK_BANDS)],
                                  "band_order int, name string, color string")
    if prob_col in scores.columns:
        p = F.col(prob_col)
        band = F.when(p >= RISK_HIGH, "High Risk").when(p >= RISK_LOW, "Medium Risk").when(p < RISK_LOW, "Low Risk")
        counts = scores.groupBy(band.alias("name")).agg(F.count(F.lit(1)).alias("value"))
        out = bands.join(counts, "name", "left").select(
            "band_order", "name", F.coalesce(F.col("value"), F.lit(0)).cast("long").alias("value"), "color")
    else:
        t = scores.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(pred_col)).cast("long").alias("pos"))
        med = F.bround(F.col("n") * FALLBACK_MEDIUM_SHARE, 0).cast("long")
        vals = t.select(F.col("pos").alias("h"), med.alias("m"), (F.col("n") - F.col("pos") - med).alias("l"))
        out = bands.crossJoin(vals).select(
            "band_order", "name",
            F.when(F.col("band_order") == 0, F.col("h")).when(F.col("band_order") == 1, F.col("m"))
            .otherwise(F.col("l")).alias("value"), "color")
    return out.orderBy("band_order").drop("band_order")


def prediction_totals(scores: DataFrame, pred_col: str = "churn_prediction") -> DataFrame:
    """AG29: total, predicted_churned, predicted_churn_rate."""
    return scores.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col(pred_col)).cast("long").alias("predicted_churned"),
                      F.bround(F.avg(F.col(pred_col).cast("double")), 6).alias("predicted_churn_rate"))


def kpis(train: DataFrame, test: DataFrame, scores: DataFrame, pred_col: str = "churn_prediction") -> DataFrame:
    """AG20: totalCustomers, overallChurnRate, avgClv, highRiskCount,
    revenueAtRisk; each input reduced to one row, then cross-joined."""
    tr = train.agg(F.count(F.lit(1)).alias("_ntr"), churn_rate_pct().alias("overallChurnRate"),
                   F.bround(F.avg("estimated_clv_usd"), 0).alias("_avg_clv"))
    te = test.agg(F.count(F.lit(1)).alias("_nte"))
    pr = scores.agg(F.coalesce(F.sum(F.col(pred_col)), F.lit(0)).cast("long").alias("highRiskCount"))
    return tr.crossJoin(te).crossJoin(pr).select(
        (F.col("_ntr") + F.col("_nte")).alias("totalCustomers"), "overallChurnRate",
        F.col("_avg_clv").cast("long").alias("avgClv"), "highRiskCount",
        F.bround(F.col("highRiskCount") * F.col("_avg_clv"), 0).cast("long").alias("revenueAtRisk"))


def class_weights(df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """AG28: pos_weight = n0 / n1 (boosters) and balanced per-class weights
    n / (2 n_c) (forests, logistic regression)."""
    t = F.col(target)
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(t == 0).alias("n0"), F.count_if(t == 1).alias("n1"))
    return c.select(
        F.bround(F.try_divide(F.col("n0").cast("double"), F.col("n1")), 6).alias("pos_weight"),
        F.bround(F.try_divide(F.col("n").cast("double"), F.col("n0") * 2), 6).alias("weight_0"),
        F.bround(F.try_divide(F.col("n").cast("double"), F.col("n1") * 2), 6).alias("weight_1"))


def with_class_weight(df: DataFrame, out: str = "weight", target: str = TARGET_COL) -> DataFrame:
    """ML4: attach the balanced weight of each row's class (one-row stats
    cross-joined, no collect)."""
    w = class_weights(df, target)
    return df.crossJoin(F.broadcast(w)).withColumn(
        out, F.when(F.col(target) == 1, F.col("weight_1")).otherwise(F.col("weight_0"))
    ).drop("pos_weight", "weight_0", "weight_1")
