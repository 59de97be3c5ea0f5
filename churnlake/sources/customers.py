"""J5 / FIXTURES F1: the customer table derived from orders, lineitem, part,
events and customer.

Plan shape (what Catalyst gets):

* ``cutoff`` (last order date minus 365 days) is one scalar from a
  one-column aggregate, resolved before planning so that
  ``o_orderdate <= cutoff`` is a literal predicate: it reaches the parquet
  scan as a pushed filter (row-group skipping on date-clustered orders) and
  no nested-loop join with a one-row table is needed.
* lineitem is joined to part (brand) and to the observed orders on the order
  key, once. One aggregate per customer then computes the line-level
  figures, including the two filtered distinct counts (brands, late orders):
  Spark expands each line once per distinct group and partial aggregation
  deduplicates (customer, brand) / (customer, order) pairs map-side, so the
  shuffle carries about one row per order plus one per bought brand. The
  first distinct level is keyed by (customer, value), so one customer with a
  third of all orders is still spread over many tasks.
* Every per-customer input is aggregated with partial (map-side)
  aggregation and joined on the customer key; AQE picks broadcast vs
  sort-merge from runtime sizes (the autoBroadcastJoinThreshold is the size
  check) and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .tables import load

CUSTOMER_SCHEMA = StructType([
    StructField("customer_id", StringType()),
    StructField("age", IntegerType()),
    StructField("gender", StringType()),
    StructField("city_tier", StringType()),
    StructField("tenure_months", IntegerType()),
    StructField("subscription_type", StringType()),
    StructField("contract_type", StringType()),
    StructField("marketing_channel", StringType()),
    StructField("avg_monthly_spend_usd", DoubleType()),
    StructField("website_visits_last_30d", IntegerType()),
    StructField("app_sessions_last_30d", IntegerType()),
    StructField("support_tickets_last_90d", IntegerType()),
    StructField("late_payments_last_12m", IntegerType()),
    StructField("discount_usage_rate", DoubleType()),
    StructField("email_open_rate", DoubleType()),
    StructField("nps_score", IntegerType()),
    StructField("products_owned", IntegerType()),
    StructField("returns_last_12m", IntegerType()),
    StructField("days_since_last_purchase", IntegerType()),
    StructField("estimated_clv_usd", DoubleType()),
    StructField("clv_segment", StringType()),
    StructField("recommended_action", StringType()),
    StructField("churned", IntegerType()),
    StructField("churned_observed", IntegerType()),
    StructField("split", StringType()),
])

ID_COL = "customer_id"
TARGET_COL = "churned"
LEAKAGE_COLS = ["recommended_action"]
# Columns of the fixture that are not reference predictors.
AUX_COLS = ["churned_observed", "split"]

# Fixed values of the fixture definition (FIXTURES.md F1).
OBSERVATION_DAYS = 365
LATE_SHIP_DAYS = 60
DISCOUNT_FLAG = 0.06
CHURN_Z_CUT = 2.95
CLV_LOW_CENTS = 130_000_000
CLV_MEDIUM_CENTS = 230_000_000
MAX_PRODUCTS = 8
SUBSCRIPTION_BY_SEGMENT = {
    "AUTOMOBILE": "Basic", "BUILDING": "Basic",
    "FURNITURE": "Standard", "HOUSEHOLD": "Standard",
}
CHANNELS = ["Email", "Organic Search", "Paid Ads", "Referral", "Social Media"]
CHURN_ACTIONS = ["Targeted win-back campaign", "Immediate retention offer"]
STAY_ACTIONS = ["Loyalty upsell", "Standard nurture"]


def _int(c: Column) -> Column:
    return c.cast("int")


ORDER_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
LINE_COLS = ["l_orderkey", "l_partkey", "l_discount", "l_returnflag", "l_shipdate"]


def build_customers(spark: SparkSession, sf_dir: str, by_order: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """F1 customer table from the TPC-H-like tables under ``sf_dir``.

    ``by_order`` = (orders, lineitem) as ``bucketed.store_by_order`` keeps
    them: these two are then joined first, bucket by bucket without a
    shuffle, and parts are looked up for the lines of observed orders only."""
    if by_order is None:
        orders, lineitem = load(spark, sf_dir, "orders", ORDER_COLS), load(spark, sf_dir, "lineitem", LINE_COLS)
    else:
        orders, lineitem = by_order[0].select(ORDER_COLS), by_order[1].select(LINE_COLS)
    part = load(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    events = load(spark, sf_dir, "events", ["user_id", "event_type"])
    customer = load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])

    # The observation cutoff and the start of the last observed year (one
    # scalar; NULL only for an empty orders table).
    max_date = orders.agg(F.max("o_orderdate")).head()[0]
    if max_date is None:
        cutoff_lit = recent_lit = F.lit(None).cast("timestamp_ntz")
    else:
        import datetime as _dt
        cutoff = max_date - _dt.timedelta(days=OBSERVATION_DAYS)
        # timestamp_ntz literals from ISO text: independent of any time zone
        cutoff_lit = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
        recent_lit = F.lit((cutoff - _dt.timedelta(days=OBSERVATION_DAYS)).isoformat(sep=" ")).cast("timestamp_ntz")
    o = orders
    observed = F.col("o_orderdate") <= cutoff_lit

    # Per customer: first/last observed order, observed spend in cents, later orders.
    ord_ = o.groupBy("o_custkey").agg(
        F.min(F.when(observed, F.col("o_orderdate"))).alias("first_o"),
        F.max(F.when(observed, F.col("o_orderdate"))).alias("last_o"),
        F.sum(F.when(observed, F.round(F.col("o_totalprice") * 100).cast("bigint")).otherwise(F.lit(0)))
        .cast("bigint").alias("spend_cents"),
        F.sum(F.when(~observed, 1).otherwise(0)).alias("future_orders"),
    )

    # Observed orders with the "last year" flag.
    obs_orders = (o.filter(observed)
                  .select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderdate") > recent_lit).alias("recent")))

    on_part, on_order = lineitem.l_partkey == part.p_partkey, lineitem.l_orderkey == obs_orders.o_orderkey
    if by_order is None:
        lo = lineitem.join(part, on_part, "inner").drop("l_partkey", "p_partkey").join(obs_orders, on_order, "inner")
    else:
        # the merge hint keeps the sorted buckets in use where the planner would broadcast a small side
        lo = lineitem.hint("merge").join(obs_orders, on_order, "inner").join(part, on_part, "inner").drop("l_partkey", "p_partkey")

    # One aggregate per customer over the joined lines. The two filtered
    # distinct counts make Spark expand each line into one row per distinct
    # group; partial aggregation right after the expand deduplicates
    # (customer, brand) and (customer, order) pairs map-side, so the shuffle
    # carries about one row per order plus one per bought brand, and
    # lineitem is scanned and joined once.
    recent = F.col("recent")
    li = lo.groupBy("o_custkey").agg(
        F.count_distinct(F.when(recent, F.col("p_brand"))).alias("brands"),
        F.avg(F.when(F.col("l_discount") >= DISCOUNT_FLAG, 1.0).otherwise(0.0)).alias("disc_rate"),
        F.count_distinct(F.when(recent & (F.datediff(F.col("l_shipdate"), F.col("o_orderdate")) > LATE_SHIP_DAYS),
                                F.col("o_orderkey"))).alias("late12"),
        F.sum(F.when((F.col("l_returnflag") == "R") & recent, 1).otherwise(0)).alias("ret12"),
    )

    def n_type(t: str) -> Column:
        return F.sum(F.when(F.col("event_type") == t, 1).otherwise(0))

    ev = events.groupBy("user_id").agg(
        n_type("view").alias("views"), n_type("click").alias("clicks"), n_type("error").alias("errors"),
        n_type("purchase").alias("purchases"), n_type("signup").alias("signups"))

    ck = F.col("c_custkey")
    j = (customer
         .join(ord_, ck == ord_.o_custkey, "left").drop("o_custkey")
         .join(li, ck == li.o_custkey, "left").drop("o_custkey")
         .join(ev, F.expr("c_custkey div 10") == ev.user_id, "left").drop("user_id")
         .withColumn("cutoff", cutoff_lit))

    seg_map = F.create_map(*[x for kv in SUBSCRIPTION_BY_SEGMENT.items() for x in map(F.lit, kv)])
    raw_months = _int(F.greatest(F.lit(1), F.floor(F.datediff(F.col("cutoff"), F.col("first_o")) / 30.0)))
    spend_cents = F.coalesce(F.col("spend_cents"), F.lit(0).cast("bigint"))
    purchases, signups = F.col("purchases"), F.col("signups")
    j = j.select(
        "*",
        F.concat(F.lit("CUST"), (F.lit(100000) + ck).cast("string")).alias("customer_id"),
        _int(F.lit(18) + (ck * 7919) % 53).alias("age"),
        F.when(ck % 25 == 0, "Other").when(ck % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.concat(F.lit("Tier "), (F.lit(1) + F.col("c_nationkey") % 3).cast("string")).alias("city_tier"),
        F.coalesce(seg_map[F.col("c_mktsegment")], F.lit("Premium")).alias("subscription_type"),
        F.when(ck % 9 < 5, "Monthly").when(ck % 9 < 7, "Quarterly").otherwise("Annual").alias("contract_type"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), _int(F.col("c_nationkey") % 5) + 1).alias("marketing_channel"),
        raw_months.alias("raw_months"),
        spend_cents.alias("spend_cents_"),
        _int(F.coalesce(F.col("views"), F.lit(0))).alias("website_visits_last_30d"),
        _int(F.coalesce(F.col("clicks"), F.lit(0))).alias("app_sessions_last_30d"),
        _int(F.floor(F.coalesce(F.col("errors"), F.lit(0)) / 5.0)).alias("support_tickets_last_90d"),
        _int(F.coalesce(F.col("late12"), F.lit(0))).alias("late_payments_last_12m"),
        F.coalesce(F.col("disc_rate"), F.lit(0.0)).alias("discount_usage_rate"),
        F.coalesce(purchases * 1.0 / F.nullif(purchases + signups, F.lit(0)), F.lit(0.0)).alias("email_open_rate"),
        _int(F.greatest(F.lit(-100), F.least(F.lit(100), F.floor((F.col("c_acctbal") - 1500) / 85.0)))).alias("nps_score"),
        _int(F.least(F.lit(MAX_PRODUCTS), F.coalesce(F.col("brands"), F.lit(0)))).alias("products_owned"),
        _int(F.coalesce(F.col("ret12"), F.lit(0))).alias("returns_last_12m"),
        _int(F.datediff(F.col("cutoff"), F.col("last_o"))).alias("days_since_last_purchase"),
        F.when(F.col("future_orders") == 0, 1).otherwise(0).alias("churned_observed"),
    )
    tenure = _int(F.greatest(F.lit(1), F.floor(F.col("raw_months") * (ck % 10 + 1) / 10.0)))
    j = j.withColumn("tenure_months", tenure)
    z = (F.lit(0.04) * (30 - F.col("tenure_months")) + F.lit(0.5) * F.col("late_payments_last_12m")
         + F.lit(0.3) * F.col("support_tickets_last_90d")
         + F.coalesce(F.col("days_since_last_purchase"), F.lit(400)) / F.lit(300.0)
         + ((ck * 7919) % 101) / F.lit(101.0))
    j = j.withColumn("churned", F.when(z > CHURN_Z_CUT, 1).otherwise(0))
    sc = F.col("spend_cents_")
    return j.select(
        "customer_id", "age", "gender", "city_tier", "tenure_months", "subscription_type", "contract_type",
        "marketing_channel",
        (F.expr("spend_cents_ div (raw_months * 300)") / 100.0).alias("avg_monthly_spend_usd"),
        "website_visits_last_30d", "app_sessions_last_30d", "support_tickets_last_90d", "late_payments_last_12m",
        F.col("discount_usage_rate").cast("double").alias("discount_usage_rate"),
        F.col("email_open_rate").cast("double").alias("email_open_rate"),
        "nps_score", "products_owned", "returns_last_12m", "days_since_last_purchase",
        (F.expr("spend_cents_ div 1000") / 100.0).alias("estimated_clv_usd"),
        F.when(sc < CLV_LOW_CENTS, "Low").when(sc < CLV_MEDIUM_CENTS, "Medium").otherwise("High").alias("clv_segment"),
        F.when((F.col("churned") == 1) & (ck % 2 == 0), CHURN_ACTIONS[0])
        .when(F.col("churned") == 1, CHURN_ACTIONS[1])
        .when(ck % 2 == 0, STAY_ACTIONS[0]).otherwise(STAY_ACTIONS[1]).alias("recommended_action"),
        _int(F.col("churned")).alias("churned"),
        _int(F.col("churned_observed")).alias("churned_observed"),
        F.when(F.expr("(c_custkey div 10) % 5") == 4, "test").otherwise("train").alias("split"),
    )


def split_frames(customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) views of the customer table; test keeps the target column
    out of reach only by convention (the reference's test file has none)."""
    return customers.filter(F.col("split") == "train"), customers.filter(F.col("split") == "test")
