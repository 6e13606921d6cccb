"""Engineered features. Everything learned from data is a fit parameter, so a batch of one row
scores like the same row inside the full table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bucket_flag, flag, guarded_ratio
from tidemark.operators.quality import coerce_numeric
from tidemark.operators.ranking import quantile_values

# Limits, weights and column lists of the feature definitions.
API_WAIT_LIMIT, INTERACTIVE_LIMIT, LARGEST_PAINT_LIMIT = 1700.0, 2000.0, 5300.0
SKEW_LIMIT = 1.5
EPSILON = 1e-5
FRUSTRATION_WEIGHTS = {
    "avg_api_wait_time_ms": 0.45,
    "trailing_30d_failed_logins_count": 0.35,
    "is_frantic_user": 0.20,
}
FRICTION_DROPS = ["avg_latency_ms", "avg_dom_load_time_ms", "avg_first_contentful_paint_ms", "avg_render_time",
                  "avg_rating", "total_failed_invoices", "persona_cluster"]
TECH_COLUMNS = ["avg_latency_ms", "avg_api_wait_time_ms", "avg_dom_load_time_ms", "avg_first_contentful_paint_ms",
                "largest_contentful_paint_ms", "avg_render_time", "avg_time_to_interactive_ms", "trailing_30d_avg_latency_ms"]
ENGAGEMENT_COLUMNS = [
    "customer_tenure_days", "total_active_days_observed", "total_login_attempts", "total_successful_logins",
    "total_failed_logins", "total_manual_logouts", "avg_daily_active_minutes", "total_clickstream_events",
    "apply_filter_clicks", "export_clicks", "frequent_refresh_clicks", "subscription_settings_clicks",
    "submit_form_clicks", "update_payment_method_clicks", "home_screen_views", "billing_screen_views",
    "report_screen_views", "workspace_screen_views", "trailing_7d_avg_active_minutes", "trailing_7d_total_logins",
    "trailing_7d_total_clicks", "trailing_30d_failed_logins_count", "active_minutes_drop_ratio_7d",
    "login_frequency_drop_ratio_7d", "avg_authentication_risk_score"]
FINANCE_COLUMNS = ["total_invoices_generated", "total_failed_invoices", "trailing_30d_failed_payments_count",
                   "total_revenue_contributed"]
SUPPORT_COLUMNS = ["total_support_tickets", "high_priority_tickets", "total_ticket_escalations",
                   "trailing_7d_support_tickets", "trailing_7d_active_open_tickets", "avg_rating"]
CONTINUOUS_COLUMNS = [c for c in ENGAGEMENT_COLUMNS if not c.startswith("trailing_") and "drop_ratio" not in c
                      and c not in ("avg_daily_active_minutes", "frequent_refresh_clicks", "avg_authentication_risk_score")
                      ] + ["total_reports_run"]
DROP_RATIO_COLUMNS = ["active_minutes_drop_ratio_7d", "login_frequency_drop_ratio_7d"]
ZERO_INFLATED_COLUMNS = list(dict.fromkeys([
    "trailing_7d_avg_active_minutes", "trailing_7d_total_logins", "trailing_7d_total_clicks", "trailing_7d_support_tickets",
    "trailing_7d_active_open_tickets", "trailing_30d_failed_payments_count", "trailing_30d_failed_logins_count",
    "trailing_30d_avg_latency_ms", *SUPPORT_COLUMNS, "total_failed_invoices", "frequent_refresh_clicks"]))
PERSONA_COLUMNS = ["largest_contentful_paint_ms", "total_clickstream_events", "active_minutes_drop_ratio_7d",
                   "trailing_30d_failed_payments_count", "total_ticket_escalations"]
TARGET_ENCODED = ["country", "industry_type", "network_carrier", "currency", "registration_source", "registration_plan_code"]
ONE_HOT = ["registration_billing_cycle", "pdf_generation_variant", "advance_search_elastic_variant",
           "employee_count_range", "annual_revenue_range", "rating_bucket"]
TEXT_COLUMNS = [*TARGET_ENCODED, *[c for c in ONE_HOT if c != "rating_bucket"]]


def typed_matrix(df: DataFrame) -> DataFrame:
    """A matrix from any source with every measure numeric; unreadable values become NULL."""
    texts = [name for name, kind in df.dtypes if kind == "string" and name not in TEXT_COLUMNS and name != "user_account_id"]
    return coerce_numeric(df, texts)


def rating_bucket(column: str) -> Column:
    """Three bands of a 1-to-5 rating; missing and out-of-range ratings count as none."""
    rating = F.col(column)
    return (F.when(rating.between(1.0, 2.5), "LOW_RATING").when((rating > 2.5) & (rating <= 4.0), "MED_RATING")
            .when((rating > 4.0) & (rating <= 5.0), "HIGH_RATING").otherwise("NO_RATING"))


def friction_features(df: DataFrame, revenue_median: float | None) -> DataFrame:
    flags = {
        "flag_severe_backend_latency": bucket_flag("avg_api_wait_time_ms", API_WAIT_LIMIT),
        "flag_poor_time_to_interactive": bucket_flag("avg_time_to_interactive_ms", INTERACTIVE_LIMIT),
        "flag_catastrophic_lcp": bucket_flag("largest_contentful_paint_ms", LARGEST_PAINT_LIMIT),
    }
    rich = F.col("total_revenue_contributed") > F.lit(revenue_median).cast("double")
    out = df.withColumns({
        **flags,
        "latency_degradation_ratio": F.col("trailing_30d_avg_latency_ms") / (F.col("avg_api_wait_time_ms") + EPSILON),
        "flag_hard_invoice_failure": flag(F.col("total_failed_invoices") > 0),
        "rating_bucket": rating_bucket("avg_rating"),
        "flag_enterprise_high_touch_cushion": flag(rich & (F.col("total_ticket_escalations") > 0)),
    })
    breaches = sum((F.col(name) for name in list(flags)[1:]), F.col(list(flags)[0]))
    return out.withColumn("total_friction_breaches", breaches).drop(*FRICTION_DROPS)


def engagement_velocity() -> Column:
    """Four recent weeks against thirty average days, relative; 0 for users with no history."""
    usual = F.col("avg_daily_active_minutes") * 30
    return guarded_ratio(F.col("trailing_7d_avg_active_minutes") * 4 - usual, usual)


def session_density() -> Column:
    """Minutes of use per click; 0 without clicks."""
    return guarded_ratio(F.col("total_active_days_observed") * F.col("avg_daily_active_minutes"), "total_clickstream_events")


def momentum_features(df: DataFrame, density_floor: float | None) -> DataFrame:
    return df.withColumns({
        "engagement_velocity_mom": engagement_velocity(), "session_density": session_density(),
        "is_frantic_user": flag(session_density() < F.lit(density_floor).cast("double")),
        "flag_rage_refresh_clicker": flag(F.col("frequent_refresh_clicks") > 0)})


def fit_thresholds(df: DataFrame) -> dict[str, float | None]:
    """Median revenue and the 10 % point of session density."""
    source = df.select("total_revenue_contributed", session_density().alias("session_density"))
    median = quantile_values(source, ["total_revenue_contributed"], [0.5]).get("total_revenue_contributed", [None])
    floor = quantile_values(source, ["session_density"], [0.1]).get("session_density", [None])
    return {"revenue_median": median[0], "density_floor": floor[0]}


def skewed_columns(df: DataFrame, columns: Sequence[str], limit: float = SKEW_LIMIT) -> list[str]:
    """Columns whose population skewness exceeds the limit."""
    present = [c for c in columns if c in df.columns]
    row = df.agg(*[F.skewness(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(present)]).first()
    return [c for i, c in enumerate(present) if row[f"s{i}"] is not None and row[f"s{i}"] > limit]


def log_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_log1p": F.log1p(F.col(c).cast("double")) for c in columns}).drop(*columns) if columns else df


def fit_frustration(df: DataFrame, weights: Mapping[str, float] = FRUSTRATION_WEIGHTS) -> dict[str, list[float]]:
    """Mean and spread per weighted column."""
    row = df.agg(*[part for i, c in enumerate(weights) for part in (
        F.avg(c).alias(f"m{i}"), F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}"))]).first()
    return {c: [row[f"m{i}"] or 0.0, (row[f"s{i}"] or 0.0) + 1e-9] for i, c in enumerate(weights)}


def frustration_index(moments: Mapping[str, Sequence[float]], weights: Mapping[str, float] = FRUSTRATION_WEIGHTS) -> Column:
    """Weighted sum of z-scores."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        mean, spread = moments[name]
        total = total + F.lit(weight) * (F.col(name) - F.lit(mean)) / F.lit(spread)
    return total
