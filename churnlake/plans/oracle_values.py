"""Bin edges, labels and column lists of the DuckDB twins, written out so that a wrong value in the code under test shows."""

INF = float("inf")

# Fixed values
AGE_EDGES = [0, 25, 35, 45, 55, INF]
AGE_LABELS = ["18-25", "26-35", "36-45", "46-55", "55+"]
RECENCY_EDGES = [0, 14, 30, 60, 90, INF]
RECENCY_LABELS = ["Very Recent", "Recent", "Moderate", "Distant", "Very Distant"]
TENURE_EDGES = [0, 6, 12, 24, 48, INF]
TENURE_LABELS = ["New (<6m)", "Early (6-12m)", "Developing (1-2y)", "Established (2-4y)", "Loyal (4y+)"]
NPS_LABELS = ["Detractor", "Passive", "Promoter"]
CATEGORICAL_FEATURES = [
    "gender", "city_tier", "subscription_type", "contract_type", "marketing_channel", "clv_segment",
    "recency_bucket", "age_group", "tenure_category", "nps_category",
]
NUMERICAL_FEATURES = [
    "age", "tenure_months", "avg_monthly_spend_usd", "website_visits_last_30d", "app_sessions_last_30d",
    "support_tickets_last_90d", "late_payments_last_12m", "discount_usage_rate", "email_open_rate",
    "nps_score", "products_owned", "returns_last_12m", "days_since_last_purchase", "estimated_clv_usd",
    "engagement_score", "spend_per_tenure", "support_intensity", "payment_reliability", "clv_spend_ratio",
    "risk_score", "high_risk", "digital_preference", "discount_dependency",
]
NEW_FEATURES = [
    "engagement_score", "spend_per_tenure", "support_intensity", "payment_reliability", "clv_spend_ratio",
    "recency_bucket", "age_group", "tenure_category", "nps_category", "risk_score", "high_risk",
    "digital_preference", "discount_dependency",
]
NON_NEGATIVE = [
    "age", "tenure_months", "avg_monthly_spend_usd", "website_visits_last_30d", "app_sessions_last_30d",
    "support_tickets_last_90d", "late_payments_last_12m", "discount_usage_rate", "email_open_rate",
    "products_owned", "returns_last_12m", "days_since_last_purchase", "estimated_clv_usd",
]
RATE_COLS = ["discount_usage_rate", "email_open_rate"]
PAYMENT_EDGES = [-1, 0, 2, 5, 999]
PAYMENT_LABELS = ["0 Late", "1-2 Late", "3-5 Late", "6+ Late"]
TENURE_IMPACT_EDGES = [0, 6, 12, 24, 48, 999]
TENURE_IMPACT_LABELS = ["New (<6m)", "Early (6-12m)", "Dev (1-2y)", "Estab (2-4y)", "Loyal (4y+)"]
CHANNELS = ["Email", "Organic Search", "Paid Ads", "Referral", "Social Media"]
CHURN_ACTIONS = ["Targeted win-back campaign", "Immediate retention offer"]
