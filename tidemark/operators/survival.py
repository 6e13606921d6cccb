"""Kaplan-Meier survival curves with a log-log confidence band."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # Fixed value: 97.5 % point of the normal distribution.


def kaplan_meier(df: DataFrame, cohort: str, duration: str, event: str) -> DataFrame:
    """Survival per cohort and distinct duration.

    Subjects are counted per (cohort, duration) first, so the windows run over at most one row per
    day of tenure and cohort.
    """
    table = (df.filter(F.col(duration).isNotNull())
             .groupBy(F.col(cohort).alias("cohort"), F.col(duration).alias("t"))
             .agg(F.count(F.lit(1)).alias("leaving"), F.count_if(F.col(event) == 1).alias("deaths")))
    onward = Window.partitionBy("cohort").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = Window.partitionBy("cohort").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_risk = table.withColumn("at_risk", F.sum("leaving").over(onward))
    d, n = F.col("deaths"), F.col("at_risk")
    extinct = F.max(F.when(d == n, 1).otherwise(0)).over(so_far) == 1
    log_survival = F.sum(F.when(d < n, F.ln(1 - d / n)).otherwise(F.lit(0.0))).over(so_far)
    greenwood = F.sum(F.when(d < n, d / (n * (n - d)).cast("double")).otherwise(F.lit(0.0))).over(so_far)
    curve = at_risk.withColumns({
        "survival": F.when(extinct, F.lit(0.0)).otherwise(F.exp(log_survival)), "greenwood": greenwood})
    # exp(-exp(log(-log s) +- z * sqrt(greenwood) / log s)); no band where s is 0 or 1.
    s = F.col("survival")
    inner = F.ln(-F.ln(s))
    spread = F.lit(Z95) * F.sqrt("greenwood") / F.ln(s)
    usable = (s > 0) & (s < 1)
    return curve.withColumns({
        "lower": F.when(usable, F.exp(-F.exp(inner - spread))).otherwise(s),
        "upper": F.when(usable, F.exp(-F.exp(inner + spread))).otherwise(s),
    }).drop("leaving", "greenwood")
