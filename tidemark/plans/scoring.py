"""Value, tiers and the prediction frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import half_even, lookup

# Fixed values.
RISK_LIMIT = 0.35
GROSS_MARGIN = 0.80
EPSILON = 1e-5
VIP_LTV_INR = 50_000.0
INR_RATES = {"INR": 1.0, "USD": 84.0, "EUR": 90.0, "JPY": 0.55, "GBP": 105.0}
VIP_LTV_NATIVE = {"USD": 600.0, "EUR": 550.0, "GBP": 500.0, "JPY": 90_000.0, "INR": 50_000.0}
VIP_LTV_DEFAULT = 600.0
VIP, EMAIL, STABLE = "VIP_RED_ALERT", "AUTOMATED_LOW_COST_EMAIL", "STABLE_NO_ACTION"
RISK_LABELS = {VIP: "CRITICAL_ENTERPRISE_RISK", EMAIL: "ELEVATED_SMB_RISK"}
RISK_LABEL_DEFAULT = "STABLE_ACCOUNT"


def revenue_in_inr(revenue: str, currency: str) -> Column:
    return F.col(revenue) * lookup(currency, INR_RATES, 1.0)


def monthly_arpu(revenue: Column, tenure_days: str) -> Column:
    """NULL where revenue or tenure is missing; ``greatest`` alone would skip a NULL tenure."""
    days = F.when(F.col(tenure_days).isNotNull(), F.greatest(F.col(tenure_days), F.lit(1)))
    return revenue / days * 30


def lifetime_value(arpu: Column, probability: str) -> Column:
    return arpu * GROSS_MARGIN / (F.col(probability) + EPSILON)


def common_currency_tier(probability: str, ltv_inr: str) -> Column:
    """Training rule: one LTV limit in one currency; a missing LTV stays stable."""
    risky = F.col(probability) >= RISK_LIMIT
    return (F.when(risky & (F.col(ltv_inr) > VIP_LTV_INR), VIP)
            .when(risky & (F.col(ltv_inr) <= VIP_LTV_INR), EMAIL).otherwise(STABLE))


def native_currency_tier(probability: str, ltv: str, currency: str) -> Column:
    """Scoring rule: LTV limit per currency; a risky row that is no VIP gets the email tier."""
    risky = F.col(probability) >= RISK_LIMIT
    valuable = F.col(ltv) > lookup(currency, VIP_LTV_NATIVE, VIP_LTV_DEFAULT)
    return F.when(risky & valuable, VIP).when(risky, EMAIL).otherwise(STABLE)


def risk_label(tier: str) -> Column:
    return lookup(tier, RISK_LABELS, RISK_LABEL_DEFAULT)


def risk_band(probability: str) -> Column:
    value = F.col(probability)
    return F.when(value < 0.30, "LOW").when(value < 0.70, "MEDIUM").when(value.isNotNull(), "HIGH")


def prediction_frame(scored: DataFrame, probability: str = "probability", driver: str = "primary_driver", keep: Sequence[str] = ()) -> DataFrame:
    """The 12 columns of the prediction table from a scored feature matrix, and those of its columns named in ``keep``."""
    arpu = monthly_arpu(F.col("total_revenue_contributed").cast("double"), "customer_tenure_days")
    valued = scored.withColumn("__arpu", arpu)
    valued = valued.withColumn("__ltv", lifetime_value(F.col("__arpu"), probability))
    return valued.select(
        F.col("user_account_id").cast("string").alias("user_account_id"), "country", "industry_type",
        "registration_plan_code", F.col("customer_tenure_days").cast("int").alias("customer_tenure_days"),
        F.col("is_churned").cast("int").alias("is_churned_historical"),
        half_even(probability, 4).alias("calibrated_churn_probability"), half_even("__arpu", 2).alias("monthly_arpu"),
        half_even("__ltv", 2).alias("projected_ltv"), "currency",
        native_currency_tier(probability, "__ltv", "currency").alias("allocated_operational_tier"),
        F.col(driver).alias("primary_frustration_driver_vector"), *keep)


def value_matrix(df: DataFrame, probability: str, revenue: str, tenure_days: str, currency: str) -> DataFrame:
    """Revenue in one currency, ARPU, LTV, tier and risk label per row."""
    out = df.withColumn("normalized_revenue_inr", revenue_in_inr(revenue, currency))
    out = out.withColumn("monthly_arpu", monthly_arpu(F.col("normalized_revenue_inr"), tenure_days))
    out = out.withColumn("calibrated_ltv", lifetime_value(F.col("monthly_arpu"), probability))
    out = out.withColumn("action_trigger", common_currency_tier(probability, "calibrated_ltv"))
    return out.withColumn("risk_tier", risk_label("action_trigger"))


def assessment_json(probability: str, tier: str, arpu: str, ltv: str, drivers: Column, anchors: Column) -> Column:
    """Nested per-user document, built for all rows in one pass."""
    return F.to_json(F.struct(
        F.struct(half_even(probability, 4).alias("calibrated_churn_probability"),
                 F.col(tier).alias("allocated_operational_tier"), risk_label(tier).alias("risk_tier")).alias("user_risk_assessment"),
        F.struct(half_even(arpu, 2).alias("monthly_arpu_inr"),
                 half_even(ltv, 2).alias("projected_lifetime_value_ltv")).alias("customer_financial_profile_inr"),
        F.struct(drivers.alias("top_frustration_vectors"), anchors.alias("top_retention_anchors")).alias("root_cause_diagnosis")))
