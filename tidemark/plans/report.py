"""The exploratory report over a feature matrix: every table behind a chart or printed profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import profiles, survival
from tidemark.operators.ranking import quantile_values
from tidemark.plans import features

LABEL, TENURE = "is_churned", "customer_tenure_days"

# Names of cohorts and segments, and which metric is read against which.
COHORTS = {
    "total_failed_invoices": ("Failed Payments", "Clean Billing History"),
    "total_ticket_escalations": ("Escalated Issues", "No Support"),
}
CUTOFFS = [
    ("avg_api_wait_time_ms", "avg_daily_active_minutes"),
    ("largest_contentful_paint_ms", "total_clickstream_events"),
    ("avg_time_to_interactive_ms", "trailing_7d_total_clicks"),
]
NEW, MATURE = "New Users", "Mature Users"
HIGH_VALUE, STANDARD_VALUE = "High-Value Account", "Standard-Value Account"
ESCALATED, CLEAN = "Has Escalations", "Clean/No Escalations"


def tenure_interaction(matrix: DataFrame) -> DataFrame:
    """Latency tier by tenure segment: median daily minutes and churn rate."""
    middle = quantile_values(matrix, [TENURE], [0.5])[TENURE][0]
    tagged = matrix.select(
        profiles.latency_tier("avg_api_wait_time_ms").alias("latency_tier"),
        F.when(F.col(TENURE) < middle, NEW).otherwise(MATURE).alias("tenure_segment"), "avg_daily_active_minutes", LABEL)
    return profiles.pivot_median_and_rate(tagged, "latency_tier", "tenure_segment", [NEW, MATURE], "avg_daily_active_minutes", LABEL)


def support_gridlock(matrix: DataFrame) -> DataFrame:
    """Support friction by revenue tier: churn rate and users."""
    middle = quantile_values(matrix, ["total_revenue_contributed"], [0.5])["total_revenue_contributed"][0]
    tagged = matrix.select(
        F.when(F.col("total_ticket_escalations") > 0, ESCALATED).otherwise(CLEAN).alias("support_friction"),
        F.when(F.col("total_revenue_contributed") > middle, HIGH_VALUE).otherwise(STANDARD_VALUE).alias("revenue_tier"), LABEL)
    return profiles.pivot_rate_and_count(tagged, "support_friction", "revenue_tier", [STANDARD_VALUE, HIGH_VALUE], LABEL)


def cohort_survival(matrix: DataFrame, segment: str) -> DataFrame:
    """Survival over tenure of users with and without the segment's event."""
    with_event, without = COHORTS[segment]
    tagged = matrix.select(F.when(F.col(segment) > 0, with_event).otherwise(without).alias("cohort"), TENURE, LABEL)
    return survival.kaplan_meier(tagged, "cohort", TENURE, LABEL)


def full_report(matrix: DataFrame) -> dict[str, DataFrame]:
    """All tables of the report by name. Write or checkpoint the matrix first: each table reads it."""
    by_class = [c for c in features.TECH_COLUMNS if c != "avg_render_time"]
    numeric = [f.name for f in matrix.schema.fields if f.dataType.typeName() in ("double", "long", "integer") and f.name not in ("user_account_id", LABEL)]
    report = {
        "class_balance": profiles.class_balance(matrix, LABEL),
        "tech_percentiles": profiles.upper_percentiles(matrix, features.TECH_COLUMNS),
        "tech_percentiles_by_class": profiles.upper_percentiles(matrix, by_class, [LABEL]),
        "tech_correlations": profiles.correlations(matrix, features.TECH_COLUMNS),
        "render_variation": profiles.variation(matrix, ["avg_render_time"]),
        "engagement_profile": profiles.univariate(matrix, features.ENGAGEMENT_COLUMNS),
        "finance_profile": profiles.univariate(matrix, features.FINANCE_COLUMNS),
        "support_profile": profiles.univariate(matrix, features.SUPPORT_COLUMNS),
        "median_shift": profiles.median_shift(matrix, features.CONTINUOUS_COLUMNS, LABEL),
        "zero_against_active": profiles.zero_against_active(matrix, features.ZERO_INFLATED_COLUMNS, LABEL),
        "tenure_interaction": tenure_interaction(matrix),
        "support_gridlock": support_gridlock(matrix),
        "strongest_features": profiles.strongest(profiles.binned_information(matrix, numeric, LABEL)),
    }
    report.update({f"rate_by_{c}": profiles.rate_by_bin(matrix, c, LABEL) for c in features.DROP_RATIO_COLUMNS})
    report.update({f"{measured}_by_{c}": profiles.median_by_bin(matrix, c, measured) for c, measured in CUTOFFS})
    report.update({f"survival_by_{segment}": cohort_survival(matrix, segment) for segment in COHORTS})
    return report
