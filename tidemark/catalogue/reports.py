"""The exploratory report over the derived feature matrix, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.base import query, rounded, sql_round as r
from tidemark.catalogue.models import PREDICTION_KEEP
from tidemark.catalogue.warehouse import MATRIX_ALL, feature_matrix, round_doubles
from tidemark.operators import profiles
from tidemark.operators.quality import strip_token
from tidemark.plans import features, report, scoring, training, warehouse
from tidemark.session import cut_lineage

LABEL = report.LABEL
RENAMED = ", ".join(f"{c} AS {c.replace('lifetime_', '')}" for c in warehouse.MATRIX_COLUMNS)
MATRIX = f"{MATRIX_ALL},\nm AS (SELECT {RENAMED} FROM matrix)"


def matrix_rows(spark, sf):
    """The matrix at four decimals, as its SQL twin has it, written once for the passes over it."""
    return cut_lineage(round_doubles(strip_token(feature_matrix(spark, sf))))


def _shift(c: str) -> str:
    low, high = f"median({c}) FILTER (WHERE {LABEL} = 0)", f"median({c}) FILTER (WHERE {LABEL} = 1)"
    return f"SELECT '{c}' AS feature, {r(low)} AS median_negative, {r(high)} AS median_positive, {r(f'({high} - {low}) / ({low} + 1e-5) * 100')} AS shift_pct FROM m"


@query("a22_matrix_median_shift", MATRIX + " " + " UNION ALL ".join(_shift(c) for c in features.CONTINUOUS_COLUMNS))
def matrix_shift(spark, sf):
    out = profiles.median_shift(matrix_rows(spark, sf), features.CONTINUOUS_COLUMNS, LABEL)
    return rounded(out, "median_negative", "median_positive", "shift_pct")


def _active(c: str) -> str:
    on, off = f"coalesce(avg({LABEL}) FILTER (WHERE {c} > 0), 0)", f"coalesce(avg({LABEL}) FILTER (WHERE NOT coalesce({c} > 0, false)), 0)"
    return (f"SELECT '{c}' AS column_name, {r(on)} AS active_rate, {r(off)} AS zero_rate, {r(f'avg({LABEL})')} AS base_rate, "
            f"{r(f'{on} * 100 / ({off} * 100 + 1e-5)')} AS lift FROM m")


@query("a25_matrix_zero_vs_active", MATRIX + " " + " UNION ALL ".join(_active(c) for c in features.ZERO_INFLATED_COLUMNS))
def matrix_triggers(spark, sf):
    out = profiles.zero_against_active(matrix_rows(spark, sf), features.ZERO_INFLATED_COLUMNS, LABEL)
    return rounded(out, "active_rate", "zero_rate", "base_rate", "lift")


_SEGMENTS = {report.NEW: "young", report.MATURE: "NOT young"}


@query("a27_tenure_interaction", f"""{MATRIX}, s AS (SELECT *, customer_tenure_days < (SELECT median(customer_tenure_days) FROM m) AS young,
  CASE WHEN avg_api_wait_time_ms <= 200 THEN 'Fast (<200ms)' WHEN avg_api_wait_time_ms <= 1500 THEN 'Degraded (200ms-1.5s)' WHEN avg_api_wait_time_ms > 1500 THEN 'Catastrophic (>1.5s)' ELSE 'Degraded' END AS latency_tier FROM m)
SELECT latency_tier, {', '.join(f'{r(f"median(avg_daily_active_minutes) FILTER (WHERE {w})")} AS "{n}_median", {r(f"avg({LABEL}) FILTER (WHERE {w})")} AS "{n}_rate"' for n, w in _SEGMENTS.items())} FROM s GROUP BY latency_tier""")
def interaction(spark, sf):
    out = report.tenure_interaction(matrix_rows(spark, sf))
    return rounded(out, *out.columns[1:])


@query("a32_cohort_survival", f"""{MATRIX}, tab AS (SELECT CASE WHEN total_failed_invoices > 0 THEN 'Failed Payments' ELSE 'Clean Billing History' END AS cohort, customer_tenure_days AS t,
  count(*) AS leaving, count(*) FILTER (WHERE {LABEL} = 1) AS deaths FROM m WHERE customer_tenure_days IS NOT NULL GROUP BY ALL),
risk AS (SELECT *, CAST(sum(leaving) OVER (PARTITION BY cohort ORDER BY t DESC) AS BIGINT) AS at_risk FROM tab)
SELECT cohort, t, deaths, at_risk, {r('CASE WHEN max((deaths = at_risk)::INTEGER) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths / at_risk::DOUBLE) ELSE 0 END) OVER w) END')} AS survival
FROM risk WINDOW w AS (PARTITION BY cohort ORDER BY t)""")
def invoice_survival(spark, sf):
    curve = report.cohort_survival(matrix_rows(spark, sf), "total_failed_invoices")
    return rounded(curve, "survival").drop("lower", "upper")


# The published columns come from the matrix; the value columns follow from the published probability within its rounding.
@query("m23_frame_rules", MATRIX + """
SELECT CAST(user_account_id AS VARCHAR) AS user_account_id, country, industry_type, registration_plan_code, CAST(customer_tenure_days AS INTEGER) AS customer_tenure_days,
       CAST(is_churned AS INTEGER) AS is_churned_historical, currency, TRUE AS probability_in_range, TRUE AS arpu_follows, TRUE AS ltv_follows, TRUE AS tier_follows FROM m""")
def frame_rules(spark, sf):
    """The scoring frame of the picked winner, with each derived column held against its rule."""
    matrix = cut_lineage(strip_token(feature_matrix(spark, sf)))
    bundle = training.train_bundle(matrix, blueprints=training.model_blueprints(max_iter=5, depth=3), folds=2)
    scored = training.score(matrix, bundle, PREDICTION_KEEP)
    frame = scoring.prediction_frame(scored, keep=["total_revenue_contributed"])
    p, ltv = F.col("calibrated_churn_probability"), F.col("projected_ltv")
    arpu = F.col("total_revenue_contributed") / F.greatest("customer_tenure_days", F.lit(1)) * 30
    cent, rounding = 0.005 + 1e-6, 0.00005 + 1e-9
    gain = arpu * scoring.GROSS_MARGIN
    least, most = gain / (p + rounding + scoring.EPSILON) - cent, gain / (F.greatest(p - rounding, F.lit(0.0)) + scoring.EPSILON) + cent
    limit = F.coalesce(*[F.when(F.col("currency") == c, F.lit(float(v))) for c, v in scoring.VIP_LTV_NATIVE.items()], F.lit(scoring.VIP_LTV_DEFAULT))
    tier = F.when(p < scoring.RISK_LIMIT, scoring.STABLE).when(ltv > limit, scoring.VIP).otherwise(scoring.EMAIL)
    on_edge = (F.abs(p - scoring.RISK_LIMIT) <= rounding) | (F.abs(ltv - limit) <= cent)
    return frame.select(
        "user_account_id", "country", "industry_type", "registration_plan_code", "customer_tenure_days", "is_churned_historical", "currency",
        p.between(0, 1).alias("probability_in_range"), (F.abs(F.col("monthly_arpu") - arpu) <= cent).alias("arpu_follows"),
        ltv.between(least, most).alias("ltv_follows"), ((F.col("allocated_operational_tier") == tier) | on_edge).alias("tier_follows"))
