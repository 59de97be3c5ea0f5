"""Feature engineering (FE4-FE16, FE21), one-hot encoding and alignment
(FE17, FE18), standardisation (FE20) and vector assembly (FE19).

Row features are projections. The three table statistics the definitions
need (max late payments, NPS terciles) form a one-row DataFrame that is
cross-joined to the rows, so "fit on train, apply to test" (R1, R2) is a
matter of which table that one row is computed from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import cut
from ..functions.scalar import clip_lower, flag
from ..sources.customers import ID_COL, LEAKAGE_COLS, TARGET_COL

# Fixed values (bin edges and labels of the feature definitions).
RECENCY_EDGES = [0, 14, 30, 60, 90, float("inf")]
RECENCY_LABELS = ["Very Recent", "Recent", "Moderate", "Distant", "Very Distant"]
AGE_EDGES = [0, 25, 35, 45, 55, float("inf")]
AGE_LABELS = ["18-25", "26-35", "36-45", "46-55", "55+"]
TENURE_EDGES = [0, 6, 12, 24, 48, float("inf")]
TENURE_LABELS = ["New (<6m)", "Early (6-12m)", "Developing (1-2y)", "Established (2-4y)", "Loyal (4y+)"]
NPS_PROBS = [0.33, 0.66]
NPS_LABELS = ["Detractor", "Passive", "Promoter"]

NEW_FEATURES = [
    "engagement_score", "spend_per_tenure", "support_intensity", "payment_reliability", "clv_spend_ratio",
    "recency_bucket", "age_group", "tenure_category", "nps_category", "risk_score", "high_risk",
    "digital_preference", "discount_dependency",
]
CATEGORICAL_FEATURES = [
    "gender", "city_tier", "subscription_type", "contract_type", "marketing_channel", "clv_segment",
    "recency_bucket", "age_group", "tenure_category", "nps_category",
]
NUMERICAL_FEATURES = [
    "age", "tenure_months", "avg_monthly_spend_usd", "website_visits_last_30d", "app_sessions_last_30d",
    "support_tickets_last_90d", "late_payments_last_12m", "discount_usage_rate", "email_open_rate", "nps_score",
    "products_owned", "returns_last_12m", "days_since_last_purchase", "estimated_clv_usd",
    "engagement_score", "spend_per_tenure", "support_intensity", "payment_reliability", "clv_spend_ratio",
    "risk_score", "high_risk", "digital_preference", "discount_dependency",
]
# Columns whose values may not be negative (quality check AG8).
NON_NEGATIVE = [
    "age", "tenure_months", "avg_monthly_spend_usd", "website_visits_last_30d", "app_sessions_last_30d",
    "support_tickets_last_90d", "late_payments_last_12m", "discount_usage_rate", "email_open_rate",
    "products_owned", "returns_last_12m", "days_since_last_purchase", "estimated_clv_usd",
]
RATE_COLS = ["discount_usage_rate", "email_open_rate"]

# The engineered features that need statistics of the whole table.
NEEDS_MAX, NEEDS_TERCILES = "payment_reliability", "nps_category"


def feature_stats(df: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """One row: the table statistics used by FE7 and FE12 (max late
    payments; exact NPS terciles by distributed selection). ``only``: the
    engineered features asked for; statistics that none of them uses are
    not computed (NULL)."""
    from ..functions.quantiles import quantile_row
    asked = lambda name: only is None or name in only
    mx = df.agg(F.max("late_payments_last_12m").alias("_max_late")) if asked(NEEDS_MAX) else _no_stats(df, "_max_late bigint")
    terciles = quantile_row(df, "nps_score", NPS_PROBS, "_nps_q") if asked(NEEDS_TERCILES) else _no_stats(df, "_nps_q array<double>")
    return mx.crossJoin(terciles)


def _no_stats(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(None,)], schema)


def engineer_features(df: DataFrame, stats: DataFrame | None = None, parity_nan: bool = False) -> DataFrame:
    """FE4-FE16 on ``df``; ``stats`` (from :func:`feature_stats`) defaults to
    the statistics of ``df`` itself (reference behaviour, R1/R2)."""
    st = stats if stats is not None else feature_stats(df)
    x = df.crossJoin(F.broadcast(st))  # one row by construction
    c = F.col
    tenure1 = clip_lower("tenure_months", 1)
    web_app = c("website_visits_last_30d") + c("app_sessions_last_30d")
    q = c("_nps_q")
    risk = (flag(c("late_payments_last_12m") >= 2) + flag(c("support_tickets_last_90d") >= 3)
            + flag(c("days_since_last_purchase") >= 60) + flag(c("email_open_rate") < 0.3)
            + flag(c("nps_score") < 0))
    out = x.select(
        *[c(n) for n in df.columns],
        web_app.alias("engagement_score"),
        (c("avg_monthly_spend_usd") / tenure1).alias("spend_per_tenure"),
        (c("support_tickets_last_90d") / tenure1).alias("support_intensity"),
        (F.lit(1.0) - c("late_payments_last_12m") / F.greatest(c("_max_late"), F.lit(1))).alias("payment_reliability"),
        (c("estimated_clv_usd") / clip_lower(c("avg_monthly_spend_usd") * 12, 1)).alias("clv_spend_ratio"),
        cut("days_since_last_purchase", RECENCY_EDGES, RECENCY_LABELS, parity_nan=parity_nan).alias("recency_bucket"),
        cut("age", AGE_EDGES, AGE_LABELS, parity_nan=parity_nan).alias("age_group"),
        cut("tenure_months", TENURE_EDGES, TENURE_LABELS, parity_nan=parity_nan).alias("tenure_category"),
        cut("nps_score", [float("-inf"), q[0], q[1], float("inf")], NPS_LABELS,
            parity_nan=parity_nan).alias("nps_category"),
        risk.alias("risk_score"),
        (risk >= 3).cast("int").alias("high_risk"),
        (c("app_sessions_last_30d") / clip_lower(web_app, 1)).alias("digital_preference"),
        (c("discount_usage_rate") * (F.lit(1.0) - c("email_open_rate"))).alias("discount_dependency"),
    )
    return out


def fit_transform_split(train: DataFrame, test: DataFrame, stats_from: str = "self",
                        parity_nan: bool = False, only: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """FE21: features for train and test. ``stats_from='self'`` refits the
    statistics on each table (reference parity); ``'train'`` applies the train
    statistics to test.

    With 'self', the NPS terciles of both tables come from one selection
    over the two tables tagged by part (one pass instead of two). ``only``
    lists the engineered features wanted: the others are left out, and no
    statistics are computed for them."""
    from ..functions.quantiles import exact_quantiles_by
    if stats_from not in ("self", "train"):
        raise ValueError("stats_from must be 'self' or 'train'")
    keep = None if only is None else [*train.columns, *only]

    def finished(df: DataFrame, st: DataFrame) -> DataFrame:
        out = engineer_features(df, st, parity_nan)
        return out if keep is None else out.select(*[c for c in keep if c in out.columns])

    if stats_from == "train":
        tr_stats = feature_stats(train, only)
        return finished(train, tr_stats), finished(test, tr_stats)
    spark, q = train.sparkSession, {}
    if only is None or NEEDS_TERCILES in only:
        both = (train.select("nps_score", F.lit("train").alias("_part"))
                .unionByName(test.select("nps_score", F.lit("test").alias("_part"))))
        q = exact_quantiles_by(both, "nps_score", NPS_PROBS, "_part")

    def stats(df: DataFrame, part: str) -> DataFrame:
        qrow = spark.createDataFrame([(q.get(part, [None] * len(NPS_PROBS)),)], "_nps_q array<double>")
        mx = df.agg(F.max("late_payments_last_12m").alias("_max_late")) if only is None or NEEDS_MAX in only else _no_stats(df, "_max_late bigint")
        return mx.crossJoin(qrow)
    return finished(train, stats(train, "train")), finished(test, stats(test, "test"))


# ---------------------------------------------------------------- encoding

MAX_CATEGORIES = 1000  # a column with more levels becomes one sparse vector instead of a column per level


def category_levels(df: DataFrame, cols: Sequence[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Distinct non-NULL values, sorted, of each column with at most
    ``max_categories`` of them; wider columns are left out (see
    :func:`one_hot_wide`).

    One distributed pass: the columns are unpivoted to (column, value) and
    deduplicated with map-side partial aggregation; only the levels of
    narrow columns reach the driver.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c_).alias("column"), F.col(c_).cast("string").alias("value")) for c_ in cols])).alias("kv")
    ).select("kv.column", "kv.value").filter(F.col("value").isNotNull()).distinct().persist()
    try:
        wide = [r["column"] for r in long.groupBy("column").count().filter(F.col("count") > max_categories).collect()]
        rows = long.filter(~F.col("column").isin(wide)).collect() if wide else long.collect()
    finally:
        long.unpersist()
    levels: dict[str, list[str]] = {c_: [] for c_ in cols if c_ not in wide}
    for r in rows:
        levels[r["column"]].append(r["value"])
    return {k: sorted(v) for k, v in levels.items()}


def one_hot_wide(train: DataFrame, frames: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """FE17 for columns with any number of levels: each becomes a sparse
    0/1 vector ``<col>_onehot`` over the train levels; NULL or an unseen value
    gives all zeros. The levels stay in the fitted indexer."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    if not cols:
        return list(frames)
    index = [f"_{c}_index" for c in cols]
    indexer = StringIndexer(inputCols=list(cols), outputCols=index, handleInvalid="keep").fit(train)
    # the extra index of unseen values is the last one, which is dropped
    encoder = OneHotEncoder(inputCols=index, outputCols=[f"{c}_onehot" for c in cols], dropLast=True).fit(indexer.transform(train))
    return [encoder.transform(indexer.transform(f)).drop(*index, *cols) for f in frames]


def one_hot(df: DataFrame, levels: dict[str, list[str]], drop_source: bool = True) -> DataFrame:
    """FE17: one 0/1 int column ``<col>_<value>`` per level (none dropped);
    NULL or an unseen value gives all zeros. Levels come from the train table
    (:func:`category_levels`), so train and test get the same columns."""
    dummies = [
        F.coalesce((F.col(c_) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c_}_{v}")
        for c_, vals in levels.items() for v in vals
    ]
    keep = [F.col(c_) for c_ in df.columns if not (drop_source and c_ in levels)]
    return df.select(*keep, *dummies)


def encoded_feature_names(df_cols: Sequence[str], exclude: Sequence[str] = (ID_COL, TARGET_COL, *LEAKAGE_COLS)) -> list[str]:
    """Sorted feature list of an encoded table (PF4)."""
    return sorted(c_ for c_ in df_cols if c_ not in set(exclude))


def align_to_train(df: DataFrame, features: Sequence[str], with_target: bool) -> DataFrame:
    """FE18: id first, the train feature list in order (missing ones as 0,
    extras dropped), target last when requested (PF10, PF2, SO3)."""
    have = set(df.columns)
    cols = [F.col(ID_COL)]
    cols += [F.col(f) if f in have else F.lit(0).alias(f) for f in features]
    if with_target:
        cols.append(F.col(TARGET_COL))
    return df.select(*cols)


def encode_split(train_feat: DataFrame, test_feat: DataFrame,
                 categorical: Sequence[str] = CATEGORICAL_FEATURES,
                 numerical: Sequence[str] = NUMERICAL_FEATURES) -> tuple[DataFrame, DataFrame, list[str]]:
    """FE17 + FE18 for a train/test pair: (train encoded, test encoded, features)."""
    levels = category_levels(train_feat, categorical)
    base = [ID_COL, *categorical, *numerical]
    wide = [c_ for c_ in categorical if c_ not in levels]
    tr, te = one_hot_wide(train_feat, [train_feat.select(*base, TARGET_COL), test_feat.select(*base)], wide)
    tr, te = one_hot(tr, levels), one_hot(te, levels)
    features = encoded_feature_names(tr.columns)
    return align_to_train(tr, features, True), align_to_train(te, features, False), features


def standardize(train: DataFrame, apply_to: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """FE20: (x - mean) / population std with train statistics; a constant
    column (std 0) maps to 0, as scikit-learn's scaler does."""
    st = train.agg(*[F.avg(f"`{c_}`").alias(f"_m{i}") for i, c_ in enumerate(cols)],
                   *[F.stddev_pop(f"`{c_}`").alias(f"_s{i}") for i, c_ in enumerate(cols)])
    x = apply_to.crossJoin(F.broadcast(st))
    scaled = []
    for i, c_ in enumerate(cols):
        s = F.col(f"_s{i}")
        denom = F.when((s == 0) | s.isNull(), F.lit(1.0)).otherwise(s)
        scaled.append(((F.col(f"`{c_}`") - F.col(f"_m{i}")) / denom).alias(c_))
    return x.select(*[F.col(k) for k in keep], *scaled)


def assemble(df: DataFrame, features: Sequence[str], out: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """FE19: feature columns to one ML vector (NULL becomes NaN-free 0 is
    *not* applied: callers impute first)."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")
    return va.transform(df).select(*keep, out)
