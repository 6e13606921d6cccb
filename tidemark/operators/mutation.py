"""Set-based changes of keyed tables: upsert, keyed update, added columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = "__matched"


def add_columns(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Add absent columns as NULL."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in df.columns}
    return df.withColumns(absent) if absent else df


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row per key; partial aggregation instead of a window over a hot key."""
    others = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("row"))
    return picked.select(key, *[F.col(f"row.{c}").alias(c) for c in others])


def upsert(base: DataFrame, batch: DataFrame, key: str, mapped: Sequence[str], loaded_at: Column,
           timestamp: str | None = None, touch_timestamp: bool = False) -> DataFrame:
    """Keyed upsert of a batch with unique keys.

    Matched rows take the mapped columns from the batch and keep the rest, even when a mapped
    value is NULL. New rows get NULL elsewhere and ``loaded_at`` as their timestamp; rows absent
    from the batch stay as they are.
    """
    mapped = [c for c in mapped if c != key]
    incoming = batch.select(key, *[F.col(c).alias(f"__new_{c}") for c in mapped], F.lit(True).alias(_MARK))
    joined = base.withColumn("__old", F.lit(True)).join(incoming, key, "full")
    arrived, is_new = F.col(_MARK).isNotNull(), F.col("__old").isNull()
    columns = []
    for field in base.schema.fields:
        current = F.col(field.name)
        if field.name in mapped:
            current = F.when(arrived, F.col(f"__new_{field.name}").cast(field.dataType)).otherwise(current)
        elif field.name == timestamp:
            renew = arrived if touch_timestamp else is_new
            current = F.when(renew, loaded_at.cast(field.dataType)).otherwise(current)
        columns.append(current.alias(field.name))
    return joined.select(*columns)


def keyed_update(base: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """Overwrite columns of the rows named by ``updates``; the last update per key wins, unknown keys are ignored."""
    last = latest_per_key(updates.select(key, *dict.fromkeys([*columns, order])), key, order)
    incoming = last.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias(_MARK))
    joined = base.join(incoming, key, "left")
    hit = F.col(_MARK).isNotNull()
    return joined.select(*[
        (F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
        for c in base.columns])


def update_counts(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows submitted and rows that name an existing key, in one job."""
    known = base.select(key).distinct().withColumn("__known", F.lit(1))
    return updates.select(key).join(known, key, "left").agg(
        F.count(F.lit(1)).alias("submitted"), F.count("__known").alias("matched"))
