"""Categorical encoding, correlation pruning and stratified splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import fits_broadcast
from tidemark.operators.profiles import correlations
from tidemark.operators.quality import safe_name
from tidemark.operators.ranking import numbered
from tidemark.session import cut_lineage

SMOOTHING, MIN_LEAF = 10.0, 20.0  # Fixed values.


def fit_target_encoding(df: DataFrame, columns: Sequence[str], label: str, smoothing: float = SMOOTHING,
                        min_leaf: float = MIN_LEAF) -> tuple[DataFrame, float | None]:
    """Smoothed label mean per category of each column, long form, and the overall mean.

    All columns share one aggregation, written once, since every column's join reads it; categories with few rows lean
    towards the overall mean. Without columns the table is empty.
    """
    prior = df.agg(F.avg(label)).first()[0]
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, category string, encoded double"), prior
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns])
    stats = (df.select(F.col(label).alias("__y"), F.inline(pairs)).filter(F.col("category").isNotNull())
             .groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean")))
    weight = 1.0 / (1.0 + F.exp(-(F.col("n") - F.lit(min_leaf)) / F.lit(smoothing)))
    encoded = weight * F.col("mean") + (1.0 - weight) * F.lit(prior)
    return cut_lineage(stats.select("feature", "category", encoded.alias("encoded"))), prior


def apply_target_encoding(df: DataFrame, table: DataFrame, columns: Sequence[str], prior: float | None) -> DataFrame:
    """Replace categories by their encoding; unseen and missing ones get the overall mean."""
    small = bool(columns) and fits_broadcast(table)
    for name in columns:
        part = table.filter(F.col("feature") == name).select(
            F.col("category").alias("__category"), F.col("encoded").alias("__encoded"))
        joined = df.join(F.broadcast(part) if small else part, F.col(name).cast("string") == F.col("__category"), "left")
        df = joined.withColumn(name, F.coalesce("__encoded", F.lit(prior))).drop("__category", "__encoded")
    return df


def fit_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels of each column, the first dropped; every level becomes a column, so the caller chooses the columns."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in columns])
    found = df.select(F.inline(pairs)).filter("level IS NOT NULL").distinct().collect()
    return {name: sorted(row["level"] for row in found if row["feature"] == name)[1:] for name in columns}


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per kept level; names are cleaned here, so fit and score agree on them."""
    columns = {safe_name(f"{name}_{level}"): F.when(F.col(name) == level, 1.0).otherwise(0.0)
               for name, kept in levels.items() for level in kept}
    return (df.withColumns(columns) if columns else df).drop(*levels)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float]:
    """Pairwise-complete correlations as a driver-side table of columns x columns numbers, from one pass over the rows."""
    found = {}
    for row in correlations(df, columns).collect():
        found[row["feature_a"], row["feature_b"]] = found[row["feature_b"], row["feature_a"]] = float("nan") if row["corr"] is None else row["corr"]
    return found


def redundant_columns(correlation: Mapping[tuple[str, str], float], columns: Sequence[str], limit: float = 0.85) -> list[str]:
    """Columns that correlate beyond the limit with any earlier column."""
    return [b for j, b in enumerate(columns)
            if any(abs(correlation.get((a, b), float("nan"))) > limit for a in columns[:j])]


def redundant_pairs(df: DataFrame, columns: Sequence[str], limit: float = 0.85) -> DataFrame:
    """Long form of the same rule for reporting."""
    return correlations(df, columns).filter((F.abs("corr") > limit) & (F.col("feature_a") != F.col("feature_b")))


def stratified_parts(df: DataFrame, label: str, key: str, parts: int, seed: int = 42, name: str = "part") -> DataFrame:
    """Deal the rows of each class evenly to ``parts``, in the order of a seeded hash of the key."""
    ordered = numbered(df, [label], F.xxhash64(F.col(key), F.lit(seed)), [key], "__no")
    return ordered.withColumn(name, (F.col("__no") % parts).cast("int")).drop("__no")
