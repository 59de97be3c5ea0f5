"""Spark side of the query catalog: one callable (spark, sf_dir) -> DataFrame
per operator of SURVEY section 2. Keys are the operator ids in lower case
plus a short name; ``oracle.py`` holds the DuckDB twin of each S query."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.binning import cut, qcut, quantile_cut
from ..operators import correlation as cor
from ..operators import directory as di
from ..operators import features as fe
from ..operators import folds as fo
from ..operators import importance as imp
from ..operators import metrics as me
from ..operators import models as mo
from ..operators import profile as pr
from ..operators import projections as pj
from ..operators import ranking as rk
from ..operators import resample as rs
from ..operators import serving as sv
from ..operators import setops as so
from ..operators import sketches as sk
from ..session import ensure_checkpoint_dir
from ..sources import bucketed
from ..sources import customers as cu
from ..sources import sinks
from ..sources.tables import read_document, source_or_fallback
from ..sources.tables import read_table, table_path
from ..operators import segments as seg
from . import base

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str, once: bool = False):
    """Register a query; ``once`` writes the customer table for its many uses."""
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            with base.customers_once():
                return fn(spark, sf)
        QUERIES[name] = run if once else fn
        return fn
    return deco


@query("j5_customer_table")
def j5_customer_table(spark, sf):
    return base.customers(spark, sf)


@query("j5_bucketed_customers")
def j5_bucketed_customers(spark, sf):
    """The customer table from orders and line items that are stored by order key."""
    import uuid
    return cu.build_customers(spark, sf, bucketed.store_by_order(spark, sf, f"churn_{uuid.uuid4().hex}"))


@query("ag24_contract_stats")
def ag24_contract_stats(spark, sf):
    tr, _ = base.train_test(spark, sf)
    return seg.contract_stats(tr)


@query("fe21_feature_table", once=True)
def fe21_feature_table(spark, sf):
    tr, te = base.features(spark, sf)
    return tr.unionByName(te)


RAW_CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
STRING_COLS = [f.name for f in cu.CUSTOMER_SCHEMA.fields if f.dataType.simpleString() == "string"]
RAW_CATEGORICAL = ["gender", "city_tier", "subscription_type", "contract_type", "marketing_channel", "clv_segment"]
SEARCH_Q, SEARCH_STATUS = "10", "Monitoring"
INDEXED_SEARCHES = [("T1001", "All"), ("monitor", "All"), ("7", "Healthy"), ("ust10", "At Risk"), ("q-none", "All")]
STORED_PAGES, STORED_KEY = (0, 1, 7), (0.5, "CUST100500")


def _scores(spark, sf):
    _, te = base.train_test(spark, sf)
    return base.reference_scores(te)


def _directory(spark, sf):
    _, te = base.train_test(spark, sf)
    return sv.customer_directory(base.reference_scores(te), te)


def _importance(spark, sf):
    tr, _, feats = base.encoded(spark, sf)
    si = imp.statistical_importance(tr, feats)
    names = si.select("feature")
    return imp.combined_importance(names, si.select("feature", "imp_a"), si.select("feature", "imp_b"))


def _ranked_models(spark, sf):
    tr, _ = base.train_test(spark, sf)
    m = me.evaluate(base.scorer_long(tr), "label", "prediction", "score", ["model"])
    return me.rank_models(m)


# --------------------------------------------------------------- 2.1 / 2.2
@query("io1_read_table")
def io1_read_table(spark, sf):
    return read_table(spark, table_path(sf, "customer"), "parquet", RAW_CUSTOMER_SCHEMA)


@query("pf1_select")
def pf1_select(spark, sf):
    return pj.select_columns(base.customers(spark, sf), ["customer_id", "tenure_months", "contract_type", "churned"])


@query("pf2_drop_leakage")
def pf2_drop_leakage(spark, sf):
    return pj.drop_columns(base.customers(spark, sf), cu.LEAKAGE_COLS)


@query("pf3_select_by_dtype")
def pf3_select_by_dtype(spark, sf):
    c = base.customers(spark, sf)
    return c.select(*pr.columns_of_type(c, ["string"]))


@query("pf4_exclude_projection")
def pf4_exclude_projection(spark, sf):
    tr, _ = base.train_test(spark, sf)
    return pj.exclude_columns(tr, [cu.ID_COL, cu.TARGET_COL, *cu.LEAKAGE_COLS, *cu.AUX_COLS])


@query("pf5_rename")
def pf5_rename(spark, sf):
    return pj.rename_columns(base.customers(spark, sf), {"customer_id": "id", "churned": "label"})


@query("pf6_filter_counts")
def pf6_filter_counts(spark, sf):
    c = F.col
    return pj.count_where(base.customers(spark, sf), {
        "nps_negative": c("nps_score") < 0,
        "tenure_le_6": c("tenure_months") <= 6,
        "tenure_12_24": (c("tenure_months") >= 12) & (c("tenure_months") < 24),
        "rate_out_of_range": (c("email_open_rate") < 0) | (c("email_open_rate") > 1),
    })


@query("pf7_or_and_filter")
def pf7_or_and_filter(spark, sf):
    c = F.col
    cust = base.customers(spark, sf)
    return cust.filter(((c("late_payments_last_12m") >= 2) | (c("support_tickets_last_90d") >= 3))
                       & (c("contract_type") == "Monthly")).select("customer_id")


@query("pf8_membership")
def pf8_membership(spark, sf):
    cust = base.customers(spark, sf)
    return cust.filter(F.col("contract_type").isin("Monthly", "Quarterly")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"))


@query("pf9_search")
def pf9_search(spark, sf):
    return sv.search_customers(_directory(spark, sf), "MONITOR", "All")


@query("pf10_add_missing_columns")
def pf10_add_missing_columns(spark, sf):
    _, te, _ = base.encoded(spark, sf)
    return te


# --------------------------------------------------------------- 2.3 joins
@query("j1_predictions_join")
def j1_predictions_join(spark, sf):
    _, te = base.train_test(spark, sf)
    s = base.reference_scores(te)
    return s.join(te.select("customer_id", "tenure_months", "estimated_clv_usd"), "customer_id", "inner")


@query("j2_importance_join", once=True)
def j2_importance_join(spark, sf):
    return _importance(spark, sf).select("feature", "imp_a", "imp_b")


@query("j3_unseen_categories", once=True)
def j3_unseen_categories(spark, sf):
    # the days have many levels, some of them in test only
    tr, te = base.features(spark, sf)
    return so.unseen_categories(tr, te, [*fe.CATEGORICAL_FEATURES, "days_since_last_purchase"])


# ------------------------------------------------------- 2.4 aggregations
@query("ag1_shape")
def ag1_shape(spark, sf):
    return pr.shape(base.train_test(spark, sf)[0])


@query("ag2_column_profile")
def ag2_column_profile(spark, sf):
    return pr.column_profile(base.train_test(spark, sf)[0])


@query("ag2_sketch_profile", once=True)
def ag2_sketch_profile(spark, sf):
    """Train and test customers as two loads: the merged estimates beside the exact counts of the whole table."""
    path = _scratch(spark, "sketches")
    for load, df in zip(("train", "test"), base.train_test(spark, sf)):
        sk.add_load(df, path, load)
    exact = pr.column_profile(base.customers(spark, sf))
    merged = sk.merged_profile(sk.stored(spark, path)).withColumnRenamed("n_unique", "estimate")
    near = F.abs(F.col("estimate") - F.col("n_unique")) <= F.ceil(F.col("n_unique") * sk.ERROR)
    return exact.join(merged.drop("dtype"), "column").select("column", "n_unique", "rows", "missing", near.alias("within_error"))


@query("ag3_target_distribution")
def ag3_target_distribution(spark, sf):
    return pr.target_distribution(base.train_test(spark, sf)[0])


@query("ag4_imbalance_ratio")
def ag4_imbalance_ratio(spark, sf):
    return pr.imbalance_ratio(base.train_test(spark, sf)[0])


@query("ag5_missing_values")
def ag5_missing_values(spark, sf):
    return pr.missing_values(base.customers(spark, sf))


@query("ag6_duplicate_rows")
def ag6_duplicate_rows(spark, sf):
    return pr.duplicate_rows(base.customers(spark, sf))


@query("ag7_duplicate_ids")
def ag7_duplicate_ids(spark, sf):
    return pr.duplicate_ids(base.customers(spark, sf))


@query("ag8_negative_values")
def ag8_negative_values(spark, sf):
    return pr.negative_values(base.train_test(spark, sf)[0], fe.NON_NEGATIVE)


@query("ag9_range_check")
def ag9_range_check(spark, sf):
    b = {"nps_score": (-100, 100), **{r: (0, 1) for r in fe.RATE_COLS}}
    return pr.range_check(base.train_test(spark, sf)[0], b)


@query("ag10_int_ranges")
def ag10_int_ranges(spark, sf):
    return pr.int_ranges(base.train_test(spark, sf)[0])


@query("ag11_iqr_outliers", once=True)
def ag11_iqr_outliers(spark, sf):
    tr = base.train_test(spark, sf)[0]
    cols = [c for c in pr.columns_of_type(tr, ["numeric"]) if c != cu.TARGET_COL]
    return pr.iqr_outliers(tr, cols)


@query("ag12_leakage_by_category")
def ag12_leakage_by_category(spark, sf):
    return pr.leakage_by_category(base.train_test(spark, sf)[0], "recommended_action")


@query("ag12_leakage_scan")
def ag12_leakage_scan(spark, sf):
    tr = base.train_test(spark, sf)[0]
    cols = [c for c in pr.columns_of_type(tr, ["string"]) if c not in (cu.ID_COL, "split")]
    return pr.leakage_scan(tr, cols)


@query("ag13_risk_segments")
def ag13_risk_segments(spark, sf):
    return seg.risk_segments(_scores(spark, sf))


@query("ag13_risk_segments_fallback")
def ag13_risk_segments_fallback(spark, sf):
    return seg.risk_segments(_scores(spark, sf).drop("churn_probability"))


@query("ag14_target_correlation")
def ag14_target_correlation(spark, sf):
    return cor.target_correlation(base.train_test(spark, sf)[0], "estimated_clv_usd")


@query("ag15_correlation_with_target", once=True)
def ag15_correlation_with_target(spark, sf):
    tr, _ = base.features(spark, sf)
    cols = [c for c in pr.columns_of_type(tr, ["numeric"]) if c != cu.TARGET_COL]
    return cor.correlation_with_target(tr, cols)


@query("ag16_correlated_pairs", once=True)
def ag16_correlated_pairs(spark, sf):
    tr, _, feats = base.encoded(spark, sf)
    return cor.correlated_pairs(tr, feats)


@query("ag17_churn_by_category", once=True)
def ag17_churn_by_category(spark, sf):
    tr, _ = base.features(spark, sf)
    return seg.churn_by_category(tr, ["recency_bucket", "age_group", "tenure_category", "nps_category", "high_risk"])


@query("ag18_feature_summary", once=True)
def ag18_feature_summary(spark, sf):
    tr, _ = base.features(spark, sf)
    return pr.feature_summary(tr, fe.NEW_FEATURES)


@query("ag19_data_dictionary", once=True)
def ag19_data_dictionary(spark, sf):
    tr, _, feats = base.encoded(spark, sf)
    return pr.data_dictionary(tr, feats)


@query("ag20_kpis", once=True)
def ag20_kpis(spark, sf):
    tr, te = base.train_test(spark, sf)
    return seg.kpis(tr, te, base.reference_scores(te))


@query("ag21_tenure_impact")
def ag21_tenure_impact(spark, sf):
    return seg.tenure_impact(base.train_test(spark, sf)[0])


@query("ag22_engagement_impact", once=True)
def ag22_engagement_impact(spark, sf):
    return seg.engagement_impact(base.features(spark, sf)[0])


@query("ag23_clv_segments")
def ag23_clv_segments(spark, sf):
    return seg.clv_segments(base.train_test(spark, sf)[0])


@query("ag25_nps_stats")
def ag25_nps_stats(spark, sf):
    return seg.nps_stats(base.features(spark, sf)[0])


@query("ag26_payment_stats")
def ag26_payment_stats(spark, sf):
    return seg.payment_stats(base.train_test(spark, sf)[0])


@query("ag27_class_distribution")
def ag27_class_distribution(spark, sf):
    return pr.class_distribution(base.train_test(spark, sf)[0])


@query("ag28_class_weights")
def ag28_class_weights(spark, sf):
    return seg.class_weights(base.train_test(spark, sf)[0])


@query("ag29_prediction_totals")
def ag29_prediction_totals(spark, sf):
    return seg.prediction_totals(_scores(spark, sf))


@query("ag30_distinct_categories")
def ag30_distinct_categories(spark, sf):
    return pr.distinct_categories(base.train_test(spark, sf)[0], RAW_CATEGORICAL)


# ----------------------------------------------------- 2.5 / 2.6 windows, sorts
@query("w1_average_rank", once=True)
def w1_average_rank(spark, sf):
    return _importance(spark, sf).select("feature", "imp_a", "rank_a", "imp_b", "rank_b")


@query("w2_top_features", once=True)
def w2_top_features(spark, sf):
    si = _importance(spark, sf)
    return rk.top_n(si.select("feature", "imp_a"), [F.col("imp_a").desc(), F.col("feature").asc()], 10)


@query("s1_sort_desc")
def s1_sort_desc(spark, sf):
    return rk.sort_desc(_scores(spark, sf), "churn_probability", "customer_id", position="position")


@query("s2_sort_abs")
def s2_sort_abs(spark, sf):
    tr, _ = base.features(spark, sf)
    cols = [c for c in pr.columns_of_type(tr, ["numeric"]) if c != cu.TARGET_COL]
    r = cor.correlation_with_target(tr, cols, top=len(cols))
    return rk.sort_abs(r, "r", "feature", position="position")


@query("s3_custom_order")
def s3_custom_order(spark, sf):
    return rk.sort_custom(seg.clv_segments(base.train_test(spark, sf)[0]), "segment", seg.CLV_ORDER, position="position")


@query("s4_topk")
def s4_topk(spark, sf):
    c = base.customers(spark, sf)
    return rk.top_n(c.select("customer_id", "estimated_clv_usd"),
                    [F.col("estimated_clv_usd").desc(), F.col("customer_id").asc()], 20)


@query("s5_argmax", once=True)
def s5_argmax(spark, sf):
    return rk.arg_max(_ranked_models(spark, sf), "model", "f1")


@query("s6_keyset_page", once=True)
def s6_keyset_page(spark, sf):
    d = _directory(spark, sf)
    first = rk.keyset_page(d, "churn_probability", "id", None, sv.PAGE_SIZE).collect()  # 15 rows: bounded
    if not first:
        return rk.keyset_page(d, "churn_probability", "id", None, sv.PAGE_SIZE)
    last = first[-1]
    return rk.keyset_page(d, "churn_probability", "id", (last["churn_probability"], last["id"]), sv.PAGE_SIZE)


# --------------------------------------------------------------- 2.7 set ops
@query("so1_id_overlap")
def so1_id_overlap(spark, sf):
    tr, te = base.train_test(spark, sf)
    return so.id_overlap(tr, te)


@query("so2_unseen_categories", once=True)
def so2_unseen_categories(spark, sf):
    tr, te = base.train_test(spark, sf)
    return so.unseen_categories(tr, te, [*RAW_CATEGORICAL, "days_since_last_purchase"])


@query("so3_schema_alignment", once=True)
def so3_schema_alignment(spark, sf):
    tr, te = base.features(spark, sf)
    levels = fe.category_levels(tr, fe.CATEGORICAL_FEATURES)
    te_levels = fe.category_levels(te, fe.CATEGORICAL_FEATURES)
    base_cols = [cu.ID_COL, *fe.NUMERICAL_FEATURES]
    tr_cols = fe.encoded_feature_names(fe.one_hot(tr.select(*base_cols, *fe.CATEGORICAL_FEATURES), levels).columns)
    te_cols = fe.encoded_feature_names(fe.one_hot(te.select(*base_cols, *fe.CATEGORICAL_FEATURES), te_levels).columns)
    return so.schema_alignment(tr_cols, te_cols, spark)


@query("so4_population_total")
def so4_population_total(spark, sf):
    tr, te = base.train_test(spark, sf)
    return so.population_total(tr, te)


# ------------------------------------------------------- 2.8 scalar functions
def _customer_scalars(spark, sf):
    """One row per customer, train and test, with the helpers of the cleaning
    and feature stages."""
    c = F.col
    return base.customers(spark, sf).select(
        "customer_id",
        sc.strip_ws(F.concat(F.lit(" \t"), c("gender"), F.lit("\n "))).alias("sc1_gender"),
        F.replace(c("marketing_channel"), F.lit(" "), F.lit("_")).alias("sc3_replaced"),
        sc.clip(c("nps_score"), 0, 50).alias("sc4_nps_clipped"),
        sc.safe_div(c("support_tickets_last_90d"), c("late_payments_last_12m")).alias("sc5_ratio"),
        sc.flag(c("days_since_last_purchase") >= 60).alias("sc6_flag"),
        sc.round_half_even(c("estimated_clv_usd"), 0).alias("sc8_clv_even"),
        sc.case_map(c("contract_type"), {"Monthly": 1, "Quarterly": 3, "Annual": 12}).alias("sc12_months"),
        F.greatest(F.abs(c("nps_score")), c("tenure_months")).alias("sc14_max_abs"),
    )


def _directory_scalars(spark, sf):
    """One row per scored (test) customer with the helpers of the customer
    directory."""
    _, te = base.train_test(spark, sf)
    s = base.reference_scores(te).select("customer_id", "churn_probability")
    x = te.join(s, "customer_id")
    c = F.col
    return x.select(
        "customer_id",
        F.lower(c("customer_id")).contains("10").alias("sc2_contains"),
        F.bround(sc.logit(c("churn_probability")), 6).alias("sc7_logit"),
        sc.round_half_up(c("churn_probability") * 100.0, 0).alias("sc9_pct_up"),
        sc.fixed(sc.round_half_up(c("churn_probability") * 100.0, 1), 1).alias("sc9_pct_fixed"),
        (sc.trunc_int(c("estimated_clv_usd")) % 14).alias("sc10_mod"),
        sc.banding(c("nps_score"), [(50, "high"), (0, "mid")], "low").alias("sc11_band"),
        F.coalesce(c("days_since_last_purchase"), F.lit(-1)).alias("sc13_days"),
        F.format_string("%s-%d", c("contract_type"), c("tenure_months")).alias("sc15_label"),
    )


for _table, _keys in (
        (_customer_scalars, ["sc1_gender", "sc3_replaced", "sc4_nps_clipped", "sc5_ratio", "sc6_flag", "sc8_clv_even",
                             "sc12_months", "sc14_max_abs"]),
        (_directory_scalars, ["sc2_contains", "sc7_logit", "sc9_pct_up", "sc9_pct_fixed", "sc10_mod", "sc11_band",
                              "sc13_days", "sc15_label"])):
    for _k in _keys:
        QUERIES[_k] = (
            lambda spark, sf, _t=_table, _c=_k: _t(spark, sf).select("customer_id", _c))


# ----------------------------------------------------------- 2.9 features
@query("fe1_cut")
def fe1_cut(spark, sf):
    c = base.customers(spark, sf)
    return c.select("customer_id", cut("days_since_last_purchase", fe.RECENCY_EDGES, fe.RECENCY_LABELS).alias("bucket"),
                    cut("days_since_last_purchase", fe.RECENCY_EDGES, fe.RECENCY_LABELS, parity_nan=True)
                    .alias("bucket_parity"))


@query("fe2_quantile_cut")
def fe2_quantile_cut(spark, sf):
    tr = base.train_test(spark, sf)[0].select("customer_id", "nps_score")
    return quantile_cut(tr, "nps_score", fe.NPS_PROBS, fe.NPS_LABELS, "nps_category")


@query("fe3_qcut")
def fe3_qcut(spark, sf):
    tr = base.train_test(spark, sf)[0].select("customer_id", "tenure_months")
    return qcut(tr, "tenure_months", 4, ["q1", "q2", "q3", "q4"], "tenure_quartile")


@query("fe7_payment_reliability_train_stats")
def fe7_payment_reliability_train_stats(spark, sf):
    tr, te = base.features(spark, sf, stats_from="train")
    return te.select("customer_id", "payment_reliability", "nps_category")


@query("fe17_one_hot", once=True)
def fe17_one_hot(spark, sf):
    tr, _, _ = base.encoded(spark, sf)
    return tr


@query("fe18_align_to_train", once=True)
def fe18_align_to_train(spark, sf):
    _, te, _ = base.encoded(spark, sf)
    return te


@query("fe20_standardize", once=True)
def fe20_standardize(spark, sf):
    tr, te, feats = base.encoded(spark, sf)
    out = fe.standardize(tr, te, feats, keep=["customer_id"])
    return out.select("customer_id", *[F.bround(F.col(f"`{c}`"), 6).alias(c) for c in feats])


@query("fe21_features_train_stats", once=True)
def fe21_features_train_stats(spark, sf):
    tr, te = base.features(spark, sf, stats_from="train")
    return tr.unionByName(te)


# ------------------------------------------- 2.10 deterministic model operators
@query("ml2_stratified_folds")
def ml2_stratified_folds(spark, sf):
    tr = base.train_test(spark, sf)[0].select("customer_id", "churned")
    return fo.stratified_folds(tr, 5)


@query("ml2_stratified_folds_exact")
def ml2_stratified_folds_exact(spark, sf):
    tr = base.train_test(spark, sf)[0].select("customer_id", "churned")
    return fo.stratified_folds(tr, 5, exact=True)


@query("ml12_holdout_split")
def ml12_holdout_split(spark, sf):
    tr = base.train_test(spark, sf)[0].select("customer_id", "churned")
    return fo.holdout_split(tr, 0.2)


@query("ml12_holdout_split_exact")
def ml12_holdout_split_exact(spark, sf):
    tr = base.train_test(spark, sf)[0].select("customer_id", "churned")
    return fo.holdout_split(tr, 0.2, exact=True)


def _test_scored(spark, sf):
    _, te = base.train_test(spark, sf)
    s = base.reference_scores(te)
    return s.join(te.select("customer_id", F.col("churned").alias("label")), "customer_id")


@query("ml13_classification_report")
def ml13_classification_report(spark, sf):
    return me.classification_report(_test_scored(spark, sf), "label", "churn_prediction")


@query("ml13_confusion_matrix")
def ml13_confusion_matrix(spark, sf):
    return me.confusion_matrix(_test_scored(spark, sf), "label", "churn_prediction")


@query("ml14_roc_auc", once=True)
def ml14_roc_auc(spark, sf):
    return me.roc_auc(_test_scored(spark, sf), "label", "churn_probability")


@query("ml14_roc_auc_by_fold", once=True)
def ml14_roc_auc_by_fold(spark, sf):
    tr = base.train_test(spark, sf)[0]
    s = fo.stratified_folds(base.rule_scorers(tr), 5)
    return me.roc_auc(s, "label", "p_c", ["fold"])


@query("ml8_soft_vote")
def ml8_soft_vote(spark, sf):
    _, te = base.train_test(spark, sf)
    v = me.soft_vote(base.rule_scorers(te), ["p_a", "p_b", "p_c"])
    return v.select("customer_id", F.bround("vote_probability", 6).alias("vote_probability"), "vote_prediction")


@query("ml10_rank_models", once=True)
def ml10_rank_models(spark, sf):
    return _ranked_models(spark, sf)


@query("ml16_combined_importance", once=True)
def ml16_combined_importance(spark, sf):
    return _importance(spark, sf)


@query("ml18_rule_score")
def ml18_rule_score(spark, sf):
    _, te = base.train_test(spark, sf)
    return te.select("customer_id", pj.is_member("recommended_action", cu.CHURN_ACTIONS).alias("churn_prediction"))


@query("ml18_rule_score_summary")
def ml18_rule_score_summary(spark, sf):
    return seg.prediction_totals(ml18_rule_score(spark, sf))


@query("ml20_model_performance", once=True)
def ml20_model_performance(spark, sf):
    return me.model_performance(_ranked_models(spark, sf))


# ------------------------------------------------------------ 2.11 serving
@query("sv1_soften")
def sv1_soften(spark, sf):
    s = _scores(spark, sf)
    return s.select("customer_id", F.bround(sc.soften("churn_probability"), 6).alias("soft_score"))


@query("sv2_customer_directory")
def sv2_customer_directory(spark, sf):
    return _directory(spark, sf)


@query("sv3_search_customers")
def sv3_search_customers(spark, sf):
    return sv.search_customers(_directory(spark, sf), SEARCH_Q, SEARCH_STATUS)


@query("sv4_page_customers")
def sv4_page_customers(spark, sf):
    return sv.page_customers(_directory(spark, sf))


def _stored(spark, sf):
    return di.store(_directory(spark, sf), _scratch(spark, "directory"))


@query("sv3_indexed_search")
def sv3_indexed_search(spark, sf):
    """Several terms on one index: part of an id, a status, too short for a trigram, nowhere."""
    d = _stored(spark, sf)
    found = [di.search(d, t, s).withColumn("term", F.lit(t)) for t, s in INDEXED_SEARCHES]
    return functools.reduce(DataFrame.unionByName, found).drop("row")


@query("sv4_stored_pages")
def sv4_stored_pages(spark, sf):
    """Pages 0, 1 and 7 of the stored directory."""
    d = _stored(spark, sf)
    pages = [di.page(d, n, sv.PAGE_SIZE).withColumn("page", F.lit(n)) for n in STORED_PAGES]
    return functools.reduce(DataFrame.unionByName, pages).drop("row")


@query("s6_stored_keyset_page")
def s6_stored_keyset_page(spark, sf):
    """The page behind a key that need not be a row's."""
    return di.page_after(_stored(spark, sf), STORED_KEY, sv.PAGE_SIZE).drop("row")


@query("sv5_risk_band")
def sv5_risk_band(spark, sf):
    d = _directory(spark, sf)
    return d.select("id", "riskScore", sv.risk_bar_colour(F.col("riskScore")).alias("colour"))


@query("sv6_churn_drivers", once=True)
def sv6_churn_drivers(spark, sf):
    return imp.churn_drivers(_importance(spark, sf))


@query("sv7_driver_percent", once=True)
def sv7_driver_percent(spark, sf):
    return imp.driver_percent(imp.churn_drivers(_importance(spark, sf)))


@query("sv8_retention_levers", once=True)
def sv8_retention_levers(spark, sf):
    tr, _ = base.train_test(spark, sf)
    trf, _ = base.features(spark, sf)
    return sv.retention_levers(tr, trf)


@query("sv9_campaign_sizing", once=True)
def sv9_campaign_sizing(spark, sf):
    tr, te = base.train_test(spark, sf)
    trf, _ = base.features(spark, sf)
    return sv.campaign_sizing(tr, te, trf, base.reference_scores(te))


@query("sv10_insight_gaps", once=True)
def sv10_insight_gaps(spark, sf):
    tr, _ = base.train_test(spark, sf)
    trf, _ = base.features(spark, sf)
    return sv.insight_gaps(tr, trf)


@query("ag22_engagement_impact_merge", once=True)
def ag22_engagement_impact_merge(spark, sf):
    return seg.engagement_impact(base.features(spark, sf)[0], on_duplicate="merge")


# ------------------------------------------------------- 2.10 fitted models (R)


def _mm(spark, sf):
    """Model matrices of train and test. Fits pass over their input many
    times, so both are cut from the customer-table lineage with a reliable
    checkpoint in the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(spark)
    tr, te, feats = base.encoded(spark, sf)
    mm = mo.model_matrix(tr, feats).checkpoint(eager=True)
    mt = mo.model_matrix(te, feats, stats_from=tr).checkpoint(eager=True)
    return mm, mt, feats


def _scratch(spark, name: str) -> str:
    """Fresh folder under the shared checkpoint directory (never a
    machine-local temp folder)."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlake-io/{name}-{uuid.uuid4().hex}"


@query("ml1_importance_scan", once=True)
def ml1_importance_scan(spark, sf):
    mm, _, feats = _mm(spark, sf)
    return mo.importance_scan(mm, feats)


@query("ml3_compare_models", once=True)
def ml3_compare_models(spark, sf):
    mm, _, _ = _mm(spark, sf)
    return mo.compare_models(mm)


@query("ml4_class_weighting")
def ml4_class_weighting(spark, sf):
    tr, _ = base.train_test(spark, sf)
    return seg.with_class_weight(tr.select("customer_id", "churned"))


@query("ml5_random_search", once=True)
def ml5_random_search(spark, sf):
    mm, _, _ = _mm(spark, sf)
    return mo.random_search(mm, "gbt_a", n_trials=10, k=5)


@query("ml5_random_search_gbt_b", once=True)
def ml5_random_search_gbt_b(spark, sf):
    mm, _, _ = _mm(spark, sf)
    return mo.random_search(mm, "gbt_b", n_trials=10, k=5)


@query("ml5_random_search_rf", once=True)
def ml5_random_search_rf(spark, sf):
    mm, _, _ = _mm(spark, sf)
    return mo.random_search(mm, "rf", n_trials=10, k=5)


@query("ml6_smote", once=True)
def ml6_smote(spark, sf):
    from pyspark.ml.functions import vector_to_array
    mm, _, _ = _mm(spark, sf)
    syn = rs.smote(mm.select("customer_id", "label", "features"), id_col="customer_id")
    return syn.select("label", "is_synthetic", vector_to_array("features").alias("features"))


@query("so5_union_synthetic", once=True)
def so5_union_synthetic(spark, sf):
    mm, _, _ = _mm(spark, sf)
    both = rs.oversample(mm.select("customer_id", "label", "features"), id_col="customer_id")
    return both.groupBy(F.col("label").cast("int").alias("label"), "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("ml7_resampled_cv", once=True)
def ml7_resampled_cv(spark, sf):
    mm, _, _ = _mm(spark, sf)
    return mo.compare_models(mm, ["Random Forest", "gbt_a", "gbt_b"], smote=True, suffix=mo.SMOTE)


@query("ml7_resampled_vote", once=True)
def ml7_resampled_vote(spark, sf):
    mm, _, _ = _mm(spark, sf)
    return mo.soft_vote_cv(mm, _stack_base(), smote=True)


@query("ml8_soft_vote_models", once=True)
def ml8_soft_vote_models(spark, sf):
    mm, _, _ = _mm(spark, sf)
    return mo.soft_vote_cv(mm, _stack_base())


def _stack_base():
    ls = mo.learners()
    return {"rf": ls["Random Forest"], "gbt_a": ls["gbt_a"], "gbt_b": ls["gbt_b"]}


@query("ml9_stacking", once=True)
def ml9_stacking(spark, sf):
    mm, _, _ = _mm(spark, sf)
    return mo.holdout_evaluate(mm, lambda tr: mo.stacking_fit(tr, _stack_base(), k=5))


@query("j4_stacking_alignment", once=True)
def j4_stacking_alignment(spark, sf):
    mm, _, _ = _mm(spark, sf)
    return mo.stacking_alignment(mm, _stack_base())


def _champion(spark, sf):
    """Split off the holdout first (R11); rank all contenders of the race
    (members, SMOTE variants, soft votes, stacking) by CV F1 on the tuning
    rows only (ML10); the champion of any kind is refitted (ML11)."""
    mm, mt, _ = _mm(spark, sf)
    tune, hold = mo.split_holdout(mm)
    r = mo.Race(tune, _stack_base(), hold=hold)
    ranked = me.rank_models(r.run()).checkpoint(eager=True)  # nine rows
    name = ranked.filter("is_champion").head()["model"]
    return ranked, r, name, mt, hold


@query("ml10_race", once=True)
def ml10_race(spark, sf):
    mm, _, _ = _mm(spark, sf)
    return me.rank_models(mo.race(mm, _stack_base()))


@query("ml11_champion_refit", once=True)
def ml11_champion_refit(spark, sf):
    _, r, name, mt, _ = _champion(spark, sf)
    return mo.predictions_table(r.scorer(name)(mt))


@query("ml15_model_importances", once=True)
def ml15_model_importances(spark, sf):
    """Of the tuned boosters, refitted on all rows: mean gain of gbt_a's splits, number of gbt_b's."""
    mm, _, feats = _mm(spark, sf)
    best = {kind: mo.best_trial(mo.random_search(mm, kind, n_trials=10, k=5), kind) for kind in ("gbt_a", "gbt_b")}
    store = mo.FitStore(mm.withColumn("fold", F.lit(0)), best).fit([(kind, (), False) for kind in best])
    of = lambda kind, by, name: mo.split_importances(store.models[kind, (), False], feats, spark, by).select("feature", F.col("importance").alias(name))
    a, b = of("gbt_a", "gain", "imp_a"), of("gbt_b", "splits", "imp_b")
    return imp.combined_importance(a.select("feature"), a, b)


@query("ml17_score", once=True)
def ml17_score(spark, sf):
    mm, mt, _ = _mm(spark, sf)
    model = mo.learners()["Logistic Regression"]().fit(mm)
    return mo.predictions_table(mo.score_frame(model, mt))


@query("ml19_model_summary", once=True)
def ml19_model_summary(spark, sf):
    ranked, r, name, mt, hold = _champion(spark, sf)
    r.store.fit(r.needs(name, r.hold) + r.needs(name))
    ho = me.evaluate(r.scorer(name, r.hold)(hold), "label", "prediction", "score")
    preds = mo.predictions_table(r.scorer(name)(mt))
    top = imp.churn_drivers(_importance(spark, sf)).select("feature")
    doc = mo.model_summary(ranked, ho, preds, top)
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("json"))


# ------------------------------------------------------------ documents, sinks
@query("fe19_assemble", once=True)
def fe19_assemble(spark, sf):
    from pyspark.ml.functions import vector_to_array
    mm, _, _ = _mm(spark, sf)
    return mm.select("customer_id", "label", vector_to_array("features").alias("features"))


def _metadata_doc(spark, sf):
    tr, te, feats = base.encoded(spark, sf)
    shp = tr.agg(F.count(F.lit(1)).alias("n")).crossJoin(te.agg(F.count(F.lit(1)).alias("m")))
    cd = pr.class_distribution(tr)
    arr = lambda xs: F.array(*map(F.lit, xs))
    return shp.crossJoin(cd).select(
        F.current_timestamp().alias("created_at"), F.lit("1.0").alias("pipeline_version"),
        F.array(F.col("n"), F.lit(len(tr.columns)).cast("long")).alias("train_shape"),
        F.array(F.col("m"), F.lit(len(te.columns)).cast("long")).alias("test_shape"),
        F.lit(cu.TARGET_COL).alias("target_column"), F.lit(cu.ID_COL).alias("id_column"),
        arr(cu.LEAKAGE_COLS).alias("leakage_columns_removed"),
        arr(fe.CATEGORICAL_FEATURES).alias("original_categorical_features"),
        arr(fe.NUMERICAL_FEATURES).alias("original_numerical_features"),
        arr(fe.NEW_FEATURES).alias("engineered_features"),
        F.lit(len(feats)).alias("total_encoded_features"),
        F.struct("not_churned", "churned", "churn_rate").alias("class_distribution"))


@query("fe22_metadata_document", once=True)
def fe22_metadata_document(spark, sf):
    d = _metadata_doc(spark, sf)
    return d.select(F.to_json(F.struct(*d.columns)).alias("json"))


@query("io2_read_document", once=True)
def io2_read_document(spark, sf):
    path = _scratch(spark, "metadata")
    sinks.write_document(_metadata_doc(spark, sf), path)
    return read_document(spark, path)


@query("io3_write_csv", once=True)
def io3_write_csv(spark, sf):
    """Train and test, each written to files of its own and read back."""
    back = []
    for name, df in zip(("train", "test"), base.train_test(spark, sf)):
        path = _scratch(spark, f"csv-{name}")
        sinks.write_csv(df, path)
        back.append(read_table(spark, path, "csv", cu.CUSTOMER_SCHEMA))
    return back[0].unionByName(back[1])


def _dashboard(spark, sf):
    tr, te = base.train_test(spark, sf)
    trf, _ = base.features(spark, sf)
    scores = base.reference_scores(te)
    return sv.dashboard_document({
        "kpis": seg.kpis(tr, te, scores), "churnDrivers": imp.churn_drivers(_importance(spark, sf)),
        "riskSegments": seg.risk_segments(scores), "tenureImpact": seg.tenure_impact(tr),
        "engagementImpact": seg.engagement_impact(trf, on_duplicate="merge"), "clvSegments": seg.clv_segments(tr),
        "contractStats": seg.contract_stats(tr), "npsStats": seg.nps_stats(trf), "paymentStats": seg.payment_stats(tr),
        "modelPerformance": me.model_performance(_ranked_models(spark, sf)),
        "retentionLevers": sv.retention_levers(tr, trf), "campaigns": sv.campaign_sizing(tr, te, trf, scores),
        "insights": sv.insight_gaps(tr, trf),
        "customerDirectorySize": sv.customer_directory(scores, te).agg(F.count(F.lit(1)).alias("rows")),
    })


DIRECTORY_FIELD = "customerDirectory"


def _write_dashboard(spark, sf) -> tuple[str, DataFrame]:
    """The whole document, directory rows included, as ordered parts; (its path, the stored rows)."""
    path = _scratch(spark, "dashboard")
    rows = _stored(spark, sf).rows
    sinks.write_document_rows(_dashboard(spark, sf), DIRECTORY_FIELD, rows, "row", path)
    return path, rows


@query("sv11_dashboard_document", once=True)
def sv11_dashboard_document(spark, sf):
    path, _ = _write_dashboard(spark, sf)
    return spark.read.text(path).withColumnRenamed("value", "json")


@query("sv11_document_directory", once=True)
def sv11_document_directory(spark, sf):
    """The directory's records, read back from the written document."""
    path, rows = _write_dashboard(spark, sf)
    return sinks.read_document_rows(spark, path, rows.drop("row").schema)


@query("sc16_document_build")
def sc16_document_build(spark, sf):
    tr, _ = base.train_test(spark, sf)
    return seg.contract_stats(tr).agg(F.to_json(F.collect_list(F.struct("contract", "churnRate", "count")))
                                      .alias("json"))


@query("io4_write_document", once=True)
def io4_write_document(spark, sf):
    """One row per file of the written document: its place in the name order and its size."""
    path, _ = _write_dashboard(spark, sf)
    files = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    return files.orderBy("file")


@query("sc17_current_timestamp")
def sc17_current_timestamp(spark, sf):
    return base.customers(spark, sf).agg(F.count(F.lit(1)).alias("rows")).withColumn("created_at", F.current_timestamp())


@query("io5_source_or_fallback", once=True)
def io5_source_or_fallback(spark, sf):
    """Both branches: from a written scores table, and from the scores where none was written."""
    written, missing = _scratch(spark, "predictions"), _scratch(spark, "predictions-not-written")
    _scores(spark, sf).write.parquet(written)

    def one(path: str, branch: str):
        out = source_or_fallback(spark, path, lambda: seg.risk_segments(spark.read.parquet(path)).withColumn("source", F.lit("table")),
                                 lambda: seg.risk_segments(_scores(spark, sf)).withColumn("source", F.lit("fallback")))
        return out.withColumn("asked", F.lit(branch))
    return one(written, "written").unionByName(one(missing, "missing"))


# FE4-FE16 one by one (each: id + the feature, train and test with their own
# statistics, as the reference computes them).
FEATURE_IDS = {
    "fe4_engagement_score": "engagement_score", "fe5_spend_per_tenure": "spend_per_tenure",
    "fe6_support_intensity": "support_intensity", "fe7_payment_reliability": "payment_reliability",
    "fe8_clv_spend_ratio": "clv_spend_ratio", "fe9_recency_bucket": "recency_bucket", "fe10_age_group": "age_group",
    "fe11_tenure_category": "tenure_category", "fe12_nps_category": "nps_category", "fe13_risk_score": "risk_score",
    "fe14_high_risk": "high_risk", "fe15_digital_preference": "digital_preference",
    "fe16_discount_dependency": "discount_dependency",
}


def _one_feature(col: str) -> Query:
    def q_(spark, sf):
        tr, te = base.features(spark, sf, only=[col])
        return tr.select("customer_id", "split", col).unionByName(te.select("customer_id", "split", col))
    return q_


# Payments, returns and discounts come from line items: those features, whose two splits and statistics would each join them
# again, write the customer table once.
FROM_LINES = {"payment_reliability", "nps_category", "risk_score", "high_risk", "discount_dependency"}
for _k, _c in FEATURE_IDS.items():
    query(_k, once=_c in FROM_LINES)(_one_feature(_c))
