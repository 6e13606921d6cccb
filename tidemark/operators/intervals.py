"""State history to validity intervals to one row per day, without a range join."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def state_intervals(history: DataFrame, entity: str, effective_at: str, tie_break: str, state: str,
                    as_of: dt.date) -> DataFrame:
    """One row per entity and state with ``valid_from`` and ``valid_to``.

    A state ends the day before the next one starts, so of several changes on one day only the
    last has any days. Those are picked first, by a partial aggregation: the window then sees at
    most one row per entity and day, however many changes a hot entity has.
    """
    last_of_day = history.groupBy(entity, F.to_date(effective_at).alias("valid_from")).agg(
        F.max_by(state, F.struct(effective_at, tie_break)).alias(state))
    order = Window.partitionBy(entity).orderBy("valid_from")
    until = F.coalesce(F.date_sub(F.lead("valid_from").over(order), 1), F.lit(as_of))
    return last_of_day.withColumn("valid_to", until)


def interval_days(intervals: DataFrame, as_of: dt.date, name: str = "activity_date") -> DataFrame:
    """Explode intervals to days up to ``as_of``. ``sequence`` counts down when its start lies
    after its end, so empty intervals are removed first."""
    last = F.least("valid_to", F.lit(as_of))
    days = F.sequence("valid_from", last, F.expr("interval 1 day"))
    return intervals.filter(F.col("valid_from") <= last).withColumn(name, F.explode(days)).drop("valid_from", "valid_to")


def interval_day_counts(intervals: DataFrame, keys: Sequence[str], as_of: dt.date) -> DataFrame:
    """Days per key straight from interval lengths, for callers that do not need the days."""
    last = F.least("valid_to", F.lit(as_of))
    length = F.datediff(last, "valid_from") + 1
    return intervals.filter(F.col("valid_from") <= last).groupBy(*keys).agg(F.sum(length).alias("days"))


def facts_by_state(intervals: DataFrame, facts: DataFrame, entity: str, day: str, state: str, as_of: dt.date) -> DataFrame:
    """Daily facts with the state that holds on their day: no day is exploded and no fact meets an interval in a join.

    State starts and facts form one ordered stream per entity, in which a fact takes the last state that began on its
    day or before. Intervals follow each other without a gap and facts hold a row or two per entity and day, so no entity
    is hot. Facts before the first state or after ``as_of`` have none and go.
    """
    starts = intervals.filter(F.col("valid_from") <= F.least("valid_to", F.lit(as_of))).select(entity, F.col("valid_from").alias(day), F.col(state).alias(state))
    stream = starts.unionByName(facts.withColumn("__fact", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy(entity).orderBy(day)     # rows of the same day see its new state
    held = stream.withColumn(state, F.last(state, ignorenulls=True).over(so_far))
    return held.filter(F.col("__fact") & F.col(state).isNotNull() & (F.col(day) <= F.lit(as_of))).drop("__fact")


def date_spine(df: DataFrame, column: str, as_of: dt.date, name: str = "date_day") -> DataFrame:
    """Every day from the earliest value of a column to ``as_of``."""
    bounds = df.agg(F.min(F.to_date(column)).alias("first"))
    return bounds.filter(F.col("first") <= F.lit(as_of)).select(
        F.explode(F.sequence("first", F.lit(as_of), F.expr("interval 1 day"))).alias(name))
