"""Average rank (W1) and combined importance (ML16) against published ranks."""

from pyspark.sql import functions as F

from churnlake.operators.importance import combined_importance
from churnlake.operators.ranking import average_rank

# Published per-feature importances of two tuned boosted models
# (feature, imp_b, imp_a, rank_b, rank_a, avg_rank); ranks are descending,
# ties share the mean position.
GOLDEN = [
    ("clv_spend_ratio", 0.2947882736156352, 0.039830368, 1.0, 5.0, 3.0),
    ("tenure_months", 0.21294788273615636, 0.02546736, 2.0, 8.0, 5.0),
    ("support_intensity", 0.020765472312703582, 0.037286427, 8.5, 6.0, 7.25),
    ("avg_monthly_spend_usd", 0.04030944625407166, 0.01844883, 5.0, 12.0, 8.5),
    ("days_since_last_purchase", 0.03420195439739414, 0.021384027, 6.0, 11.0, 8.5),
    ("tenure_category_Loyal (4y+)", 0.011807817589576547, 0.08454517, 16.0, 2.0, 9.0),
    ("risk_score", 0.008550488599348535, 0.07466616, 18.5, 3.0, 10.75),
    ("products_owned", 0.08957654723127036, 0.012289448, 3.0, 20.0, 11.5),
    ("email_open_rate", 0.020765472312703582, 0.015941514, 8.5, 15.0, 11.75),
    ("support_tickets_last_90d", 0.012622149837133551, 0.025458956, 15.0, 9.0, 12.0),
    ("discount_usage_rate", 0.019543973941368076, 0.01448128, 10.0, 17.0, 13.5),
    ("estimated_clv_usd", 0.04234527687296417, 0.009530091, 4.0, 24.0, 14.0),
    ("payment_reliability", 0.004478827361563518, 0.04332567, 25.0, 4.0, 14.5),
    ("nps_score", 0.019136807817589578, 0.014185511, 11.0, 18.0, 14.5),
    ("spend_per_tenure", 0.033794788273615636, 0.01023005, 7.0, 22.0, 14.5),
    ("tenure_category_Established (2-4y)", 0.005700325732899023, 0.022873286, 22.0, 10.0, 16.0),
    ("digital_preference", 0.015472312703583062, 0.01337116, 14.0, 19.0, 16.5),
    ("tenure_category_Developing (1-2y)", 0.004071661237785016, 0.03043671, 26.0, 7.0, 16.5),
    ("website_visits_last_30d", 0.007328990228013029, 0.016986528, 21.0, 14.0, 17.5),
    ("app_sessions_last_30d", 0.005293159609120521, 0.015174129, 23.0, 16.0, 19.5),
    ("discount_dependency", 0.016286644951140065, 0.008503995, 12.5, 27.0, 19.75),
    ("engagement_score", 0.008550488599348535, 0.0087409355, 18.5, 26.0, 22.25),
    ("late_payments_last_12m", 0.009771986970684038, 0.007932687, 17.0, 30.0, 23.5),
    ("age", 0.016286644951140065, 0.0042447993, 12.5, 35.0, 23.75),
    ("clv_segment_High", 0.00040716612377850165, 0.32574138, 49.5, 1.0, 25.25),
    ("contract_type_Annual", 0.002035830618892508, 0.011716667, 31.5, 21.0, 26.25),
    ("tenure_category_New (<6m)", 0.008143322475570033, 0.005022473, 20.0, 33.0, 26.5),
    ("returns_last_12m", 0.004885993485342019, 0.0068217684, 24.0, 31.0, 27.5),
    ("high_risk", 0.0016286644951140066, 0.009620831, 36.0, 23.0, 29.5),
    ("recency_bucket_Distant", 0.002035830618892508, 0.008299595, 31.5, 29.0, 30.25),
    ("tenure_category_Early (6-12m)", 0.00040716612377850165, 0.017469333, 49.5, 13.0, 31.25),
    ("subscription_type_Standard", 0.002035830618892508, 0.006737503, 31.5, 32.0, 31.75),
    ("gender_Female", 0.002035830618892508, 0.0048185904, 31.5, 34.0, 32.75),
    ("contract_type_Quarterly", 0.0008143322475570033, 0.008852593, 42.5, 25.0, 33.75),
    ("marketing_channel_Referral", 0.0016286644951140066, 0.004128487, 36.0, 36.0, 36.0),
    ("city_tier_Tier 1", 0.0028501628664495114, 0.0, 27.0, 50.0, 38.5),
    ("clv_segment_Medium", 0.0024429967426710096, 0.0, 28.0, 50.0, 39.0),
    ("city_tier_Tier 2", 0.0008143322475570033, 0.004127748, 42.5, 37.0, 39.75),
    ("recency_bucket_Very Distant", 0.0008143322475570033, 0.0028401727, 42.5, 38.0, 40.25),
    ("marketing_channel_Social Media", 0.002035830618892508, 0.0, 31.5, 50.0, 40.75),
    ("contract_type_Monthly", 0.002035830618892508, 0.0, 31.5, 50.0, 40.75),
    ("recency_bucket_Moderate", 0.0, 0.008467805, 57.0, 28.0, 42.5),
    ("subscription_type_Basic", 0.0016286644951140066, 0.0, 36.0, 50.0, 43.0),
    ("marketing_channel_Paid Ads", 0.0012214983713355048, 0.0, 38.0, 50.0, 44.0),
    ("clv_segment_Low", 0.0008143322475570033, 0.0, 42.5, 50.0, 46.25),
    ("age_group_36-45", 0.0008143322475570033, 0.0, 42.5, 50.0, 46.25),
    ("marketing_channel_Organic Search", 0.0008143322475570033, 0.0, 42.5, 50.0, 46.25),
    ("nps_category_Promoter", 0.0008143322475570033, 0.0, 42.5, 50.0, 46.25),
    ("nps_category_Passive", 0.0008143322475570033, 0.0, 42.5, 50.0, 46.25),
    ("nps_category_Detractor", 0.00040716612377850165, 0.0, 49.5, 50.0, 49.75),
    ("gender_Male", 0.00040716612377850165, 0.0, 49.5, 50.0, 49.75),
    ("city_tier_Tier 3", 0.00040716612377850165, 0.0, 49.5, 50.0, 49.75),
    ("marketing_channel_Email", 0.00040716612377850165, 0.0, 49.5, 50.0, 49.75),
    ("age_group_46-55", 0.0, 0.0, 57.0, 50.0, 53.5),
    ("age_group_18-25", 0.0, 0.0, 57.0, 50.0, 53.5),
    ("age_group_26-35", 0.0, 0.0, 57.0, 50.0, 53.5),
    ("gender_Other", 0.0, 0.0, 57.0, 50.0, 53.5),
    ("age_group_55+", 0.0, 0.0, 57.0, 50.0, 53.5),
    ("recency_bucket_Very Recent", 0.0, 0.0, 57.0, 50.0, 53.5),
    ("recency_bucket_Recent", 0.0, 0.0, 57.0, 50.0, 53.5),
    ("subscription_type_Premium", 0.0, 0.0, 57.0, 50.0, 53.5),
]


def test_average_rank_matches_published_ranks(spark):
    df = spark.createDataFrame([(f, b) for f, b, a, rb, ra, av in GOLDEN], "feature string, v double")
    got = {r["feature"]: r["rk"] for r in average_rank(df, "v", "rk").collect()}
    assert got == {f: rb for f, b, a, rb, ra, av in GOLDEN}


def test_combined_importance_matches_published(spark):
    a = spark.createDataFrame([(f, a) for f, b, a, rb, ra, av in GOLDEN], "feature string, imp_a double")
    b = spark.createDataFrame([(f, b) for f, b, a, rb, ra, av in GOLDEN], "feature string, imp_b double")
    out = combined_importance(a.select("feature"), a, b).collect()
    got = {r["feature"]: (r["rank_a"], r["rank_b"], r["avg_rank"]) for r in out}
    assert got == {f: (ra, rb, av) for f, b, a, rb, ra, av in GOLDEN}
    ranks = [r["avg_rank"] for r in out]
    assert ranks == sorted(ranks)


def test_average_rank_null_and_ascending(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0), ("d", 3.0)], "f string, v double")
    got = {r["f"]: r["rk"] for r in average_rank(df, "v", "rk", ascending=True).collect()}
    assert got == {"a": 1.5, "c": 1.5, "d": 3.0, "b": None}
