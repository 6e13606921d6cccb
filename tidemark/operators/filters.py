"""Review filters over a prediction table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import as_column
from tidemark.sources.schemas import AUDIT_COLUMNS

PENDING = "PENDING_REVIEW"


def in_tier(df: DataFrame, tier: str, column: str = "allocated_operational_tier") -> DataFrame:
    return df.filter(F.col(column) == tier)


def only_approved(df: DataFrame, column: str = "audit_action_status") -> DataFrame:
    if column not in df.columns:
        return df.limit(0)
    return df.filter(F.upper(column) == "APPROVED")


def search_any(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """Rows where the text of any column holds the term, ignoring case. NULL never matches."""
    if not term:
        return df
    hit = F.lit(False)
    for name in df.columns:
        text = F.col(name).cast("string")
        found = F.lower(text).contains(term.lower()) if literal else text.rlike(f"(?i){term}")
        hit = hit | F.coalesce(found, F.lit(False))
    return df.filter(hit)


def choose(df: DataFrame, choices: Mapping[str, Sequence[object]]) -> DataFrame:
    """Keep the chosen values per column; no choice and absent columns do not filter."""
    for name, values in choices.items():
        if values and name in df.columns:
            df = df.filter(F.col(name).cast("string").isin([str(v) for v in values]))
    return df


def numeric_rules(df: DataFrame, rules: Mapping[str, tuple]) -> DataFrame:
    """Rules like ``("between", 5, 1)``, ``(">=", 3)``, ``("<=", 3)`` or ``("=", 3)``; NULL fails each."""
    for name, (mode, *bounds) in rules.items():
        column = F.col(name)
        if mode == "between":
            df = df.filter(column.between(min(bounds), max(bounds)))
        else:
            df = df.filter({">=": column >= bounds[0], "<=": column <= bounds[0], "=": column == bounds[0]}[mode])
    return df


def binary_flag(df: DataFrame, column: str, values: Sequence[int]) -> DataFrame:
    if column not in df.columns or not values:
        return df
    return df.filter(F.col(column).isin([int(v) for v in values]))


def option_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values of a column in order."""
    text = F.col(column).cast("string")
    return df.select(text.alias("option")).filter("option IS NOT NULL AND option <> ''").distinct().orderBy("option")


def numeric_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value and whether every value is whole, one row per column."""
    one_row = df.agg(*[part for i, c in enumerate(columns) for part in (
        F.min(c).cast("double").alias(f"{i}_min_value"), F.max(c).cast("double").alias(f"{i}_max_value"),
        F.bool_and(F.col(c) % 1 == 0).alias(f"{i}_whole"))])
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{i}_{m}").alias(m) for m in ("min_value", "max_value", "whole")])
        for i, c in enumerate(columns)])))


def with_audit_columns(df: DataFrame) -> DataFrame:
    """Add the review columns where they are absent and default the status."""
    texts = {"audit_action_status": PENDING, "audit_notes": "", "audit_override_by": ""}
    for field in AUDIT_COLUMNS.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(texts.get(field.name)).cast(field.dataType))
    return df.withColumn("audit_action_status", F.coalesce("audit_action_status", F.lit(PENDING)))


def bulk_decision(df: DataFrame, status: str, note: str, user: str, at: dt.datetime) -> DataFrame:
    return df.withColumns({
        "audit_action_status": F.lit(status), "audit_notes": F.lit(note), "audit_override_by": F.lit(user),
        "audit_override_at": F.lit(at).cast(T.TimestampNTZType())})


def stamp_edits(df: DataFrame, user: str, at: dt.datetime) -> DataFrame:
    """Fill a blank reviewer and a missing review time."""
    return df.withColumns({
        "audit_override_by": F.when(F.col("audit_override_by") == "", F.lit(user)).otherwise(F.col("audit_override_by")),
        "audit_override_at": F.coalesce("audit_override_at", F.lit(at).cast(T.TimestampNTZType()))})


def route(df: DataFrame, column: str, branches: Sequence[str]) -> dict[str, DataFrame]:
    """One DataFrame per branch value; other values belong to no branch."""
    return {value: df.filter(as_column(column) == value) for value in branches}


def recent(df: DataFrame, order: str, tie_break: str, count: int = 200) -> DataFrame:
    return df.orderBy(F.desc(order), F.desc(tie_break)).limit(count)


def first_rows(df: DataFrame, order: Sequence[str], count: int = 5) -> DataFrame:
    """A preview: the first rows in a stated order; each task sends on at most ``count`` rows."""
    return df.orderBy(*order).limit(count)


def tier_counts(df: DataFrame, column: str = "allocated_operational_tier") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
