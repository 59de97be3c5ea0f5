"""Serving-side tables of the dashboard (SV1-SV11).

The customer directory is a join + projection + global sort: it is written
as a distributed table (one file per partition), never gathered into one
document. The dashboard document holds only the small aggregate tables,
whose sizes are bounded by their bucket counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import banding, soften
from . import segments as seg

# Fixed values (dashboard definitions).
TEMPERATURE = 2.5
STATUS_CUTS = [(70, "At Risk"), (35, "Monitoring")]
STATUS_DEFAULT = "Healthy"
BAR_CUTS = [(75, "#f43f5e"), (35, "#f59e0b")]
BAR_DEFAULT = "#34d399"
RECOVERY_SHARE = 0.12
PAGE_SIZE = 15


def customer_directory(scores: DataFrame, test: DataFrame, prob_col: str = "churn_probability") -> DataFrame:
    """SV2: scores joined to test customers, softened risk score, status,
    int CLV / tenure, synthetic last-active text (R13); riskiest first."""
    j = scores.join(test.select("customer_id", "estimated_clv_usd", "tenure_months"), "customer_id", "inner")
    prob = soften(F.col(prob_col), TEMPERATURE)
    j = j.withColumn("_prob", prob)
    return j.select(
        F.col("customer_id").alias("id"),
        F.col("estimated_clv_usd").cast("int").alias("clv"),
        F.col("tenure_months").cast("int").alias("tenure"),
        F.col("_prob").cast("int").alias("riskScore"),
        banding(F.col("_prob"), STATUS_CUTS, STATUS_DEFAULT).alias("status"),
        F.concat((F.col("_prob") % 14 + 1).cast("int").cast("string"), F.lit(" days ago")).alias("lastActive"),
        F.col(prob_col).alias("churn_probability"),
    ).orderBy(F.col("churn_probability").desc(), F.col("id").asc())


def search_customers(directory: DataFrame, query: str = "", status: str = "All") -> DataFrame:
    """SV3 / PF9: case-insensitive substring on id or status (literal
    ``contains``, not LIKE, so user text may hold % or _), AND the status
    filter unless it is 'All'."""
    q = F.lit(query.lower())
    cond = F.lower(F.col("id")).contains(q) | F.lower(F.col("status")).contains(q)
    if status != "All":
        cond = cond & (F.col("status") == F.lit(status))
    return directory.filter(cond)


def page_customers(directory: DataFrame, after: tuple | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """SV4 / S6: next page after (churn_probability, id) of the last row."""
    from .ranking import keyset_page
    return keyset_page(directory, "churn_probability", "id", after, size)


def risk_bar_colour(score: Column) -> Column:
    """SV5: bar colour bands (> 75, > 35)."""
    return banding(score, BAR_CUTS, BAR_DEFAULT)


def lever_inputs(train: DataFrame, train_feat: DataFrame) -> DataFrame:
    """Long table (table, label, churnRate, count) of the segment tables the
    levers compare (AG21, AG23-AG26), looked up by label, not position."""
    def tag(df, table, key):
        cols = df.columns
        cnt = F.col("count").cast("long") if "count" in cols else F.lit(None).cast("long")
        return df.select(F.lit(table).alias("table"), F.col(key).alias("label"), "churnRate", cnt.alias("count"))
    return (tag(seg.clv_segments(train), "clv", "segment")
            .unionByName(tag(seg.tenure_impact(train), "tenure", "tenure"))
            .unionByName(tag(seg.contract_stats(train), "contract", "contract"))
            .unionByName(tag(seg.payment_stats(train), "payment", "group"))
            .unionByName(tag(seg.nps_stats(train_feat), "nps", "category")))


LEVERS = [
    ("clv-optimization", "clv", "Low", "High"),
    ("early-tenure", "tenure", "New (<6m)", "Loyal (4y+)"),
    ("contract-annual", "contract", "Monthly", "Annual"),
    ("payment-grace", "payment", "3-5 Late", "0 Late"),
    ("nps-improvement", "nps", "Detractor", "Promoter"),
]


def retention_levers(train: DataFrame, train_feat: DataFrame) -> DataFrame:
    """SV8: per lever the two compared segments, their churn rates and
    counts, and the gap (1 dp)."""
    li = lever_inputs(train, train_feat)
    spark = train.sparkSession
    lv = spark.createDataFrame(LEVERS, "lever string, table string, label_a string, label_b string")
    a = li.select("table", F.col("label").alias("label_a"), F.col("churnRate").alias("rate_a"),
                  F.col("count").alias("count_a"))
    b = li.select("table", F.col("label").alias("label_b"), F.col("churnRate").alias("rate_b"),
                  F.col("count").alias("count_b"))
    out = lv.join(a, ["table", "label_a"], "left").join(b, ["table", "label_b"], "left")
    return out.select("lever", "label_a", "rate_a", "count_a", "label_b", "rate_b", "count_b",
                      F.bround(F.col("rate_a") - F.col("rate_b"), 1).alias("gap"))


def _rates_row(li: DataFrame) -> DataFrame:
    pairs = {
        "monthly_rate": ("contract", "Monthly"), "annual_rate": ("contract", "Annual"),
        "detractor_rate": ("nps", "Detractor"), "promoter_rate": ("nps", "Promoter"),
        "low_clv_rate": ("clv", "Low"), "medium_clv_rate": ("clv", "Medium"), "high_clv_rate": ("clv", "High"),
        "late0_rate": ("payment", "0 Late"), "late35_rate": ("payment", "3-5 Late"),
    }
    counts = {"detractor_count": ("nps", "Detractor"), "promoter_count": ("nps", "Promoter"),
              "monthly_count": ("contract", "Monthly")}
    key = F.concat_ws("|", F.col("table"), F.col("label"))
    li = li.withColumn("_k", key)
    return li.agg(*[F.first(F.when(F.col("_k") == f"{t}|{lab}", F.col("churnRate")), ignorenulls=True).alias(n)
                    for n, (t, lab) in pairs.items()],
                  *[F.first(F.when(F.col("_k") == f"{t}|{lab}", F.col("count")), ignorenulls=True).alias(n)
                    for n, (t, lab) in counts.items()])


def insight_gaps(train: DataFrame, train_feat: DataFrame) -> DataFrame:
    """SV10: metric, value: the compared rates and their gaps (1 dp)."""
    r = _rates_row(lever_inputs(train, train_feat))
    metrics = {
        "monthly_vs_annual_gap": F.bround(F.col("monthly_rate") - F.col("annual_rate"), 1),
        "detractor_vs_promoter_gap": F.bround(F.col("detractor_rate") - F.col("promoter_rate"), 1),
        "low_clv_rate": F.col("low_clv_rate"), "medium_clv_rate": F.col("medium_clv_rate"),
        "high_clv_rate": F.col("high_clv_rate"),
        "late0_rate": F.col("late0_rate"), "late35_rate": F.col("late35_rate"),
    }
    return r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"))
                                        for k, v in metrics.items()])).alias("m")).select("m.*")


def campaign_sizing(train: DataFrame, test: DataFrame, train_feat: DataFrame, scores: DataFrame) -> DataFrame:
    """SV9: campaign, segment_size, value, unit.

    targeted-retention: predicted churners and revenue at risk (AG20);
    nps-detractor-outreach: detractors and round(count x avgClv x 0.12);
    monthly-to-annual: monthly customers and the monthly - annual gap."""
    k = seg.kpis(train, test, scores)
    r = _rates_row(lever_inputs(train, train_feat))
    x = k.crossJoin(r)
    rows = [
        ("targeted-retention", F.col("highRiskCount"), F.col("revenueAtRisk").cast("double"), "usd_at_risk"),
        ("nps-detractor-outreach", F.col("detractor_count"),
         F.round(F.col("detractor_count") * F.col("avgClv") * RECOVERY_SHARE, 0), "usd_recovered"),
        ("monthly-to-annual", F.col("monthly_count"),
         F.round(F.col("monthly_rate") - F.col("annual_rate"), 1), "churn_points"),
    ]
    return x.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("campaign"), s.cast("long").alias("segment_size"), v.cast("double").alias("value"),
                 F.lit(u).alias("unit")) for n, s, v, u in rows])).alias("c")).select("c.*")


def dashboard_document(parts: dict[str, DataFrame]) -> DataFrame:
    """SV11: one row, one struct field per part (each an array of records),
    JSON-encoded in a ``json`` column. Parts must be bounded aggregate tables
    (the customer directory is written on its own, see module doc)."""
    spark = next(iter(parts.values())).sparkSession
    doc = spark.range(1).select(F.lit(1).alias("_k"))
    for name, df in parts.items():
        # keep each table's row order: an order key taken after its sort
        # (monotone across range-sorted partitions), sorted on, then dropped
        rec = F.struct(*[F.col(c) for c in df.columns])
        ordered = df.select(F.monotonically_increasing_id().alias("_o"), rec.alias("_r"))
        agg = ordered.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_r"))), lambda x: x["_r"])
                          .alias(name))
        doc = doc.crossJoin(agg)
    body = [c for c in doc.columns if c != "_k"]
    return doc.select(F.to_json(F.struct(*body)).alias("json"))
