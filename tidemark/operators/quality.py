"""Staging fixes and data-quality reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import to_number
from tidemark.operators.ranking import exact_quantiles


def drop_unwanted(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def fill_nulls(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(constants))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many rows repeat an earlier one: rows minus distinct rows."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def _long(df: DataFrame, columns: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Turn one row of ``<i>_<measure>`` columns into one row per column."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("column_name"), *[F.col(f"{i}_{m}").alias(m) for m in measures])
        for i, name in enumerate(columns)])
    return df.select(F.inline(rows))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column in one pass."""
    columns = list(columns or df.columns)
    one_row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{i}_null_count") for i, c in enumerate(columns)])
    return _long(one_row, columns, ["null_count"])


def null_indicators(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """True where a value is missing, next to the key columns to keep."""
    return df.select(*keep, *[F.col(c).isNull().alias(c) for c in columns or df.columns])


def table_profile(df: DataFrame) -> DataFrame:
    """Type, rows and filled values per column in one pass."""
    names = df.columns
    types = dict(df.dtypes)
    one_row = df.agg(*[part for i, c in enumerate(names) for part in (
        F.lit(types[c]).alias(f"{i}_data_type"), F.count(F.lit(1)).alias(f"{i}_row_count"),
        F.count(c).alias(f"{i}_filled_count"))])
    return _long(one_row, names, ["data_type", "row_count", "filled_count"])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, spread and exact quartiles per numeric column."""
    one_row = df.agg(*[part for i, c in enumerate(columns) for part in (
        F.count(c).alias(f"{i}_filled"), F.avg(c).alias(f"{i}_mean"), F.stddev_samp(c).alias(f"{i}_std"),
        F.min(c).cast("double").alias(f"{i}_min_value"), F.max(c).cast("double").alias(f"{i}_max_value"))])
    moments = _long(one_row, columns, ["filled", "mean", "std", "min_value", "max_value"])
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        F.col("feature").alias("column_name"), F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return moments.join(quartiles, "column_name", "left")


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns to double; what is no number becomes NULL. Absent names are skipped."""
    return df.withColumns({c: to_number(c) for c in columns if c in df.columns})


def strip_token(df: DataFrame, token: str = "lifetime_") -> DataFrame:
    return df.toDF(*[c.replace(token, "") for c in df.columns])


def columns_with(columns: Sequence[str], keywords: Sequence[str]) -> list[str]:
    return [c for c in columns if any(k in c for k in keywords)]


# Characters that a learner rejects in feature names.
NAME_REPLACEMENTS = {"[": "_", "]": "_", "<": "lt_", ">": "gt_"}


def safe_name(name: str) -> str:
    return re.sub(r"[\[\]<>]", lambda hit: NAME_REPLACEMENTS[hit.group()], name)


def safe_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[safe_name(c) for c in df.columns])


def align_columns(df: DataFrame, wanted: Sequence[str], missing: float = 0.0) -> DataFrame:
    """Exactly the wanted columns in the wanted order; absent ones get a constant."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(missing).alias(c) for c in wanted])


# Audit decisions a reviewer may record.
AUDIT_STATUSES = (
    "PENDING_REVIEW", "APPROVED", "BLOCKED", "MANUALLY_OVERRIDDEN", "ESCALATED_TO_CS",
    "ESCALATED_TO_SALES", "EMAIL_AUTOMATION_QUEUED", "DO_NOT_CONTACT",
)


def status_violations(df: DataFrame, column: str = "audit_action_status",
                      allowed: Sequence[str] = AUDIT_STATUSES) -> DataFrame:
    """Rows whose status is missing or outside the list."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(list(allowed)))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report key values that occur more than once (fan-out risk of a join)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


# Fixed value: the text form of a uuid.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def readability(df: DataFrame, uuids: Sequence[str] = (), jsons: Sequence[str] = ()) -> DataFrame:
    """Values, and values that are no uuid or no JSON, per column: one pass, long form; NULLs are neither."""
    checks = {**{c: F.col(c).rlike(UUID) for c in uuids}, **{c: F.get_json_object(c, "$").isNotNull() for c in jsons}}
    one_row = df.agg(*[part for i, (c, good) in enumerate(checks.items()) for part in (
        F.count(c).alias(f"{i}_filled"), F.count_if(F.col(c).isNotNull() & ~good).alias(f"{i}_unreadable"))])
    return _long(one_row, list(checks), ["filled", "unreadable"])


def fan_out(df: DataFrame, key: str) -> DataFrame:
    """Keys, rows and the most rows of one key: more than one row per key multiplies what is joined to it."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("repeated"))
