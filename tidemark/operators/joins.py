"""Joins whose shape matters at scale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fill_defaults


def full_outer_daily(left: DataFrame, right: DataFrame, keys: Sequence[str],
                     defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Full outer join of two rollups on shared keys; the keys come from whichever side has the row.

    Both sides hold one row per key, so no key can be hot here.
    """
    return fill_defaults(left.join(right, list(keys), "full"), defaults or {})


def left_join_many(one: DataFrame, many: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join where the right side may hold a huge number of rows for one key.

    A left outer join cannot split a hot right side. Written as an inner join (which AQE splits on
    either side) plus the left rows without a partner, it can.
    """
    keys = list(keys)
    matched = one.join(many, keys, "inner")
    alone = one.join(many.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def scalar_lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, values: Mapping[str, str]) -> DataFrame:
    """Add looked-up values for a key that is unique in ``table``; unknown keys give NULL.

    A duplicated key fails the query, as a scalar subquery with two rows does. Catalyst broadcasts
    the table only if its measured size is below the session's limit.
    """
    per_key = table.groupBy(F.col(table_key).alias("__key")).agg(
        F.count(F.lit(1)).alias("__copies"), *[F.max(source).alias(name) for name, source in values.items()])
    joined = df.join(per_key, F.col(key) == F.col("__key"), "left")
    guard = F.when(F.col("__copies") > 1, F.raise_error(F.lit(f"lookup key {table_key} is not unique")))
    checked = joined.withColumns({
        name: F.when(F.col("__copies") > 1, guard.cast(joined.schema[name].dataType)).otherwise(F.col(name))
        for name in values})
    return checked.drop("__key", "__copies")


def rate_lookup(df: DataFrame, rates: DataFrame, key: str, rate_key: str, rate: str, name: str, default: float) -> DataFrame:
    """Left lookup of a number with a default for unknown keys."""
    table = rates.select(F.col(rate_key).alias("__rate_key"), F.col(rate).alias("__rate"))
    joined = df.join(table, F.col(key) == F.col("__rate_key"), "left")
    return joined.withColumn(name, F.coalesce("__rate", F.lit(default))).drop("__rate_key", "__rate")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the rows of ``df`` together stay below the session's own limit for broadcasts: one aggregation of their sizes.

    For results of a fit whose size Catalyst cannot know; where they grow too large, the join stays an ordinary one.
    """
    held = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return held <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
