"""Exploratory profiles of a feature table: shifts, bins, pivots, associations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.moments import pairwise_correlations
from tidemark.operators.quality import _long
from tidemark.operators.ranking import exact_quantiles, quantile_values, unpivot_numeric

EPSILON = 1e-5  # Fixed value: keeps shift and lift denominators away from zero.


def upper_percentiles(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                      probs: Sequence[float] = (0.95, 0.99, 0.999)) -> DataFrame:
    return exact_quantiles(df, columns, probs, by)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair in one pass, long form; missing values count for nothing in their own pairs."""
    return pairwise_correlations(df, columns)


def variation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, spread, coefficient of variation (0 for a zero mean) and population skewness."""
    one_row = df.agg(*[part for i, c in enumerate(columns) for part in (
        F.avg(c).alias(f"{i}_mean"), F.stddev_samp(c).alias(f"{i}_std"), F.skewness(c).alias(f"{i}_skew"))])
    ratio = F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(F.col("std") / F.col("mean"))
    return _long(one_row, columns, ["mean", "std", "skew"]).withColumn("coef_variation", ratio)


def univariate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, spread, range, share of NULLs and of zeros per column."""
    one_row = df.agg(*[part for i, c in enumerate(columns) for part in (
        F.avg(c).alias(f"{i}_mean"), F.stddev_samp(c).alias(f"{i}_std"),
        F.min(c).cast("double").alias(f"{i}_min_value"), F.max(c).cast("double").alias(f"{i}_max_value"),
        (F.count_if(F.col(c).isNull()) / F.count(F.lit(1)) * 100).alias(f"{i}_null_pct"),
        (F.count_if(F.col(c) == 0) / F.count(F.lit(1)) * 100).alias(f"{i}_zero_pct"))])
    rest = _long(one_row, columns, ["mean", "std", "min_value", "max_value", "null_pct", "zero_pct"])
    medians = exact_quantiles(df, columns, [0.5]).select(F.col("feature").alias("column_name"), F.col("q0").alias("median"))
    return rest.join(medians, "column_name", "left")


def median_shift(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Median per class and the percent shift of the positive class."""
    medians = exact_quantiles(df, columns, [0.5], [label])
    wide = medians.groupBy("feature").agg(
        F.max(F.when(F.col(label) == 0, F.col("q0"))).alias("median_negative"),
        F.max(F.when(F.col(label) == 1, F.col("q0"))).alias("median_positive"))
    shift = (F.col("median_positive") - F.col("median_negative")) / (F.col("median_negative") + EPSILON) * 100
    return wide.withColumn("shift_pct", shift)


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Quantile edges per column, repeated edges dropped: a fit parameter of ``bins + 1`` numbers."""
    found = quantile_values(df, columns, [i / bins for i in range(bins + 1)])
    return {name: sorted(set(edges)) for name, edges in found.items()}


def bin_index(column: str | Column, edges: Sequence[float]) -> Column:
    """Right-closed bin number from 0; the lowest edge belongs to the first bin, outside gives NULL."""
    value = F.col(column) if isinstance(column, str) else column
    if len(edges) < 2:
        return F.lit(None).cast("int")
    chain = F.when((value < F.lit(edges[0])) | (value > F.lit(edges[-1])), F.lit(None).cast("int"))
    for number, edge in enumerate(edges[1:]):
        chain = chain.when(value <= F.lit(edge), F.lit(number))
    return chain


def rate_by_bin(df: DataFrame, column: str, label: str, bins: int = 5) -> DataFrame:
    """Rows and label rate per quantile bin."""
    edges = bin_edges(df, [column], bins).get(column, [])
    placed = df.select(bin_index(column, edges).alias("bin"), F.col(column).alias("__v"), F.col(label).alias("__y"))
    return placed.filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows_in_bin"), F.avg("__y").alias("label_rate"),
        F.min("__v").cast("double").alias("lowest"), F.max("__v").cast("double").alias("highest"))


def median_by_bin(df: DataFrame, column: str, measured: str, bins: int = 10) -> DataFrame:
    """Median of one column per quantile bin of another."""
    edges = bin_edges(df, [column], bins).get(column, [])
    placed = df.select(bin_index(column, edges).alias("bin"), F.col(measured).alias("measured")).filter("bin IS NOT NULL")
    return exact_quantiles(placed, ["measured"], [0.5], ["bin"]).select("bin", F.col("q0").alias("median_value"))


def zero_against_active(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Label rate where a column is above zero and where it is not, their lift, and the overall rate."""
    one_row = df.agg(*[part for i, c in enumerate(columns) for part in (
        F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(label))), F.lit(0.0)).alias(f"{i}_active_rate"),
        F.coalesce(F.avg(F.when(~F.coalesce(F.col(c) > 0, F.lit(False)), F.col(label))), F.lit(0.0)).alias(f"{i}_zero_rate"),
        F.avg(label).alias(f"{i}_base_rate"))])
    rates = _long(one_row, columns, ["active_rate", "zero_rate", "base_rate"])
    # Rates are compared in percent, so the guard weighs as little as it should.
    return rates.withColumn("lift", F.col("active_rate") * 100 / (F.col("zero_rate") * 100 + EPSILON))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(label).alias("positive_rate"),
                  (F.count_if(F.col(label) == 0) / F.nullif(F.count_if(F.col(label) == 1), F.lit(0))).alias("imbalance"))


# Limits and names of the latency tiers.
LATENCY_TIERS = (("Fast (<200ms)", 200.0), ("Degraded (200ms-1.5s)", 1500.0))
LATENCY_WORST, LATENCY_UNKNOWN = "Catastrophic (>1.5s)", "Degraded"


def latency_tier(column: str) -> Column:
    (fast, fast_limit), (slow, slow_limit) = LATENCY_TIERS
    value = F.col(column)
    return (F.when(value <= fast_limit, fast).when(value <= slow_limit, slow)
            .when(value > slow_limit, LATENCY_WORST).otherwise(LATENCY_UNKNOWN))


def pivot_median_and_rate(df: DataFrame, row: str, across: str, across_values: Sequence[str],
                          measured: str, label: str) -> DataFrame:
    """Pivot with the median of one column and the mean of another in each cell."""
    cells = df.groupBy(row, across).agg(F.avg(label).alias("rate"))
    medians = exact_quantiles(df, [measured], [0.5], [row, across]).select(row, across, F.col("q0").alias("median"))
    joined = cells.join(medians, [row, across], "left")
    return joined.groupBy(row).pivot(across, list(across_values)).agg(
        F.max("median").alias("median"), F.max("rate").alias("rate"))


def pivot_rate_and_count(df: DataFrame, row: str, across: str, across_values: Sequence[str], label: str) -> DataFrame:
    cells = df.groupBy(row, across).agg(F.avg(label).alias("rate"), F.count(label).alias("rows"))
    return cells.groupBy(row).pivot(across, list(across_values)).agg(
        F.max("rate").alias("rate"), F.max("rows").alias("rows"))


def group_means(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def catch_rate(df: DataFrame, targeted: Column, label: str) -> DataFrame:
    """True and false positives, missed positives and the share of positives caught."""
    counts = df.agg(
        F.count_if((F.col(label) == 1) & targeted).alias("true_positives"),
        F.count_if((F.col(label) == 0) & targeted).alias("false_positives"),
        F.count_if((F.col(label) == 1) & ~targeted).alias("false_negatives"))
    positives = F.col("true_positives") + F.col("false_negatives")
    return counts.withColumn("catch_rate", F.col("true_positives") / (positives + EPSILON))


def binned_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 20,
                       edges: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """Mutual information (nats) between each quantile-binned column and the label.

    Rows with any NULL among the columns are left out. One aggregation over (feature, bin, label)
    serves all columns; the joint table then is tiny.
    """
    # One condition per column: a single condition over all of them (as ``dropna`` makes) multiplies
    # in Catalyst's constraint propagation with every aliased column.
    full = df.filter(F.col(label).isNotNull())
    for name in columns:
        full = full.filter(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))
    edges = edges or bin_edges(full, columns, bins)
    # One row per column: small enough to broadcast whatever the data.
    table = df.sparkSession.createDataFrame(
        [(c, [float(e) for e in edges.get(c, [])]) for c in columns], "feature string, edges array<double>")
    long = unpivot_numeric(full.withColumn("y", F.col(label)), columns, ["y"]).join(F.broadcast(table), "feature")
    below = F.size(F.filter("edges", lambda edge: edge < F.col("value")))
    cells = long.groupBy("feature", F.greatest(below - 1, F.lit(0)).alias("bin"), "y").agg(F.count(F.lit(1)).alias("n"))
    # At most features x bins x labels rows reach these windows.
    joint = cells.select(
        "feature", "n", F.sum("n").over(Window.partitionBy("feature", "bin")).alias("n_bin"),
        F.sum("n").over(Window.partitionBy("feature", "y")).alias("n_label"), F.sum("n").over(Window.partitionBy("feature")).alias("n_all"))
    score = F.col("n") / F.col("n_all") * F.ln(F.col("n") * F.col("n_all") / (F.col("n_bin") * F.col("n_label")))
    return joint.groupBy("feature").agg(F.sum(score).alias("information"))


def strongest(associations: DataFrame, count: int = 5) -> DataFrame:
    return associations.orderBy(F.desc("information"), "feature").limit(count)
