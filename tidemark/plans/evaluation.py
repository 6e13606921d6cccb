"""Ranking and calibration measures, exact and without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import running_totals


def score_steps(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score with their totals from the highest score down.

    Rows without a score (NULL or NaN) have no place in the ranking and are left out; ``unscored`` counts them.
    """
    per_score = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return running_totals(per_score, "threshold", ["pos", "neg"], descending=True)


def unscored(df: DataFrame, score: str) -> DataFrame:
    """Rows, and rows without a score."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(score).isNull() | F.isnan(F.col(score).cast("double"))).alias("unscored"))


def precision_recall(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision and recall at every threshold; ``last_*`` is the point before it on the curve."""
    steps = score_steps(df, score, label)
    positives = steps.agg(F.sum("pos")).first()[0]
    before_pos, before_neg = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    total = F.nullif(F.lit(positives), F.lit(0))
    first = (before_pos + before_neg) == 0
    return steps.select(
        "threshold", "pos", "neg", "cum_pos", "cum_neg",
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (F.col("cum_pos") / total).alias("recall"),
        F.when(first, F.lit(1.0)).otherwise(before_pos / F.nullif(before_pos + before_neg, F.lit(0))).alias("last_precision"),
        (before_pos / total).alias("last_recall"))


def curve_summary(df: DataFrame, score: str, label: str, near: float = 0.35) -> DataFrame:
    """Average precision (step sum), trapezoid area, Brier score and the point nearest a threshold."""
    curve = precision_recall(df, score, label)
    rise = F.col("recall") - F.col("last_recall")
    distance = F.struct(F.abs(F.col("threshold") - near), F.col("threshold"))
    squared = F.col("pos") * F.pow(F.col("threshold") - 1, 2) + F.col("neg") * F.pow("threshold", 2)
    return curve.agg(
        F.sum(rise * F.col("precision")).alias("average_precision"),
        F.sum(rise * (F.col("precision") + F.col("last_precision")) / 2).alias("pr_area"),
        (F.sum(squared) / F.sum(F.col("pos") + F.col("neg"))).alias("brier_score"),
        F.min_by("threshold", distance).alias("near_threshold"),
        F.min_by("precision", distance).alias("near_precision"), F.min_by("recall", distance).alias("near_recall"))


def calibration_bins(df: DataFrame, score: str, label: str, bins: int = 5) -> DataFrame:
    """Mean score and share of positives per equal-width bin; bins are right-closed, empty ones absent."""
    value = F.col(score)
    chain = F.when(value.isNull(), F.lit(None).cast("int"))
    for number in range(bins - 1):
        chain = chain.when(value <= F.lit((number + 1) / bins), F.lit(number))
    return df.select(chain.otherwise(F.lit(bins - 1)).alias("bin"), value.alias("__s"), F.col(label).alias("__y")).filter(
        "bin IS NOT NULL").groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows_in_bin"), F.avg("__s").alias("mean_predicted"), F.avg("__y").alias("fraction_positive"))
