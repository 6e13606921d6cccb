"""The matrix's behaviour measures as a state per user that takes one day at a time.

A state row holds what days add up to (sums, counts, first and last day) and the last 31 days one by one. States of
disjoint days merge: sums add, the day lists are joined and what has fallen out of the longest window goes. So the state of
a day is the state of the day before merged with that day's partitions of the daily tables; nothing older is read. A full
build is the same function over all days at once.

The row's size is bounded by the calendar (31 days), not by the user's history or subscriptions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import flag
from tidemark.plans.warehouse import (
    DAY, LIFETIME_MEANS, LIFETIME_SUMS, SNAPSHOT_ACTIVITY, SNAPSHOT_BILLING, SNAPSHOT_SUPPORT, SUBSCRIPTION, TRAILING_SUMS, USER,
)

LONGEST = 30
#: Subscriptions whose days share a partition. Quiet days are wide rows of zeros, which shuffle to next to nothing and are
#: large in memory, so partitions sized by their shuffled bytes hold too many of them.
SUBSCRIPTIONS_PER_PARTITION = 5_000
MINUTES, LATENCY, LARGEST = "daily_total_duration_sec", "daily_avg_latency_ms", "daily_largest_contentful_paint_ms"
#: Daily columns that add up over days, and those that the trailing windows need day by day.
SUMMED = list(dict.fromkeys([*LIFETIME_SUMS.values(), *LIFETIME_MEANS.values(), MINUTES]))
RECENT = list(dict.fromkeys([*[column for _, column in TRAILING_SUMS.values()], MINUTES, LATENCY]))
FACTS = {name: fact for name, (fact, _) in {**SNAPSHOT_ACTIVITY, **SNAPSHOT_SUPPORT, **SNAPSHOT_BILLING}.items() if name in {*SUMMED, *RECENT, LARGEST}}
DAILY_TABLES = ("subscription_lifecycle_daily", "user_activity_daily", "customer_support_daily", "billing_and_revenue_daily")


def partitions_for(subscriptions: int) -> int:
    """In how many partitions the days of so many subscriptions lie, so that a task's memory does not grow with the input."""
    return subscriptions // SUBSCRIPTIONS_PER_PARTITION + 1


def user_days(spine: DataFrame, activity: DataFrame, support: DataFrame, billing: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per user and day with an open subscription; activity and support count once per subscription, bills once.

    ``partitions`` (see ``partitions_for``) fixes how many the spine is dealt to; without it the session decides.
    """
    def dealt(*keys: str) -> DataFrame:
        return spine.repartition(partitions, *keys) if partitions else spine

    opened = dealt(USER, DAY).groupBy(USER, DAY).agg(F.count(F.lit(1)).alias("open"), F.max(flag(F.col("subscription_status") == "CANCELLED")).alias("cancelled"))
    bills = [name for name in FACTS if name in SNAPSHOT_BILLING]
    billed = (billing.select(SUBSCRIPTION, DAY, *[F.col(FACTS[name]).alias(name) for name in bills])
              .join(dealt(SUBSCRIPTION, DAY).select(SUBSCRIPTION, DAY, USER), [SUBSCRIPTION, DAY]).groupBy(USER, DAY).agg(*[F.sum(name).alias(name) for name in bills]))
    joined = opened
    for table, columns in ((activity, SNAPSHOT_ACTIVITY), (support, SNAPSHOT_SUPPORT)):
        joined = joined.join(table.select(USER, DAY, *[F.col(fact).alias(name) for name, fact in FACTS.items() if name in columns]), [USER, DAY], "left")
    joined = joined.join(billed, [USER, DAY], "left")
    once = {LARGEST, *bills}
    filled = {name: F.coalesce(F.col(name), F.lit(0)) for name in FACTS}
    return joined.select(USER, DAY, "open", "cancelled", *[(filled[n] if n in once else filled[n] * F.col("open")).alias(n) for n in FACTS])


def state_of(days: DataFrame, partitions: int | None = None) -> DataFrame:
    """The state of some user-days: a partial state if they are one day, the whole state if they are all."""
    if partitions:
        days = days.repartition(partitions, USER)
    final = days.groupBy(USER).agg(F.max(DAY).alias("__final"))
    recent = F.col(DAY) >= F.date_sub("__final", LONGEST)
    entry = F.struct(F.col(DAY).alias("day"), F.col("open"), *RECENT)
    return days.join(final, USER).groupBy(USER).agg(
        F.min(DAY).alias("first_active_date"), F.max(DAY).alias("final_active_date"), F.max("cancelled").alias("is_churned"),
        F.count(F.lit(1)).alias("days"), F.sum("open").alias("subscription_days"), F.max(LARGEST).alias(LARGEST),
        *[F.sum(name).alias(name) for name in SUMMED],
        F.array_sort(F.collect_list(F.when(recent, entry))).alias("recent"))      # at most LONGEST + 1 days


def merge(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The state of the days of both; no day may be in both."""
    left, right = earlier.alias("a"), later.alias("b")
    joined = left.join(right, F.col(f"a.{USER}") == F.col(f"b.{USER}"), "full")

    def both(name: str, combine) -> Column:
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        return F.coalesce(combine(a, b), a, b)        # NULL where one side has no such user

    final = F.greatest("a.final_active_date", "b.final_active_date")
    held = F.concat(F.coalesce("a.recent", F.array()), F.coalesce("b.recent", F.array()))
    return joined.select(
        F.coalesce(f"a.{USER}", f"b.{USER}").alias(USER),
        F.least("a.first_active_date", "b.first_active_date").alias("first_active_date"), final.alias("final_active_date"),
        F.greatest("a.is_churned", "b.is_churned").alias("is_churned"),
        *[both(name, lambda a, b: a + b).alias(name) for name in ("days", "subscription_days")],
        F.greatest(f"a.{LARGEST}", f"b.{LARGEST}").alias(LARGEST),
        *[both(name, lambda a, b: a + b).alias(name) for name in SUMMED],
        F.array_sort(F.filter(held, lambda e: e["day"] >= F.date_sub(final, LONGEST))).alias("recent"))


def measures(state: DataFrame) -> DataFrame:
    """Anchors and measures per user, in the columns of ``behaviour_from_facts``."""
    def window(back: int):
        return F.filter("recent", lambda e: e["day"] >= F.date_sub("final_active_date", back))

    def total(back: int, name: str) -> Column:
        kind = state.schema["recent"].dataType.elementType[name].dataType
        return F.aggregate(window(back), F.lit(0).cast(kind), lambda acc, e: acc + e[name])

    def mean(sum_: Column, count: Column) -> Column:
        return F.coalesce(sum_, F.lit(0.0)) / F.nullif(count, F.lit(0))

    return state.select(
        USER, "first_active_date", "final_active_date", "is_churned", F.col("days").alias("lifetime_total_active_days_observed"),
        (mean(F.col(MINUTES), F.col("subscription_days")) / 60.0).alias("lifetime_avg_daily_active_minutes"),
        *[F.col(column).alias(name) for name, column in LIFETIME_SUMS.items()],
        *[mean(F.col(column), F.col("subscription_days")).alias(name) for name, column in LIFETIME_MEANS.items()],
        F.col(LARGEST).alias("lifetime_largest_contentful_paint_ms"),
        (mean(total(7, MINUTES), total(7, "open")) / 60.0).alias("trailing_7d_avg_active_minutes"),
        mean(total(30, LATENCY), total(30, "open")).alias("trailing_30d_avg_latency_ms"),
        *[total(back, column).alias(name) for name, (back, column) in TRAILING_SUMS.items()])


def _one_day(spark: SparkSession, layer: str, day: dt.date) -> DataFrame:
    """The user-days of one date: one partition of each daily table."""
    tables = [spark.read.parquet(f"{layer}/{name}").filter(F.col(DAY) == F.lit(day)) for name in DAILY_TABLES]
    return user_days(*tables)


def build_state(spark: SparkSession, layer: str, root: str, day: dt.date) -> None:
    """The state as of ``day`` from all days of the daily tables of ``layer``."""
    tables = [spark.read.parquet(f"{layer}/{name}").filter(F.col(DAY) <= F.lit(day)) for name in DAILY_TABLES]
    partitions = partitions_for(tables[0].filter(F.col(DAY) == F.lit(day)).count())
    state_of(user_days(*tables, partitions), partitions).write.mode("overwrite").parquet(f"{root}/as_of={day}")


def advance_state(spark: SparkSession, layer: str, root: str, day: dt.date) -> None:
    """The state as of ``day`` from that of the day before and the day's own partitions; repeating it replaces its result."""
    before = spark.read.parquet(f"{root}/as_of={day - dt.timedelta(days=1)}")
    merge(before, state_of(_one_day(spark, layer, day))).write.mode("overwrite").parquet(f"{root}/as_of={day}")


def read_measures(spark: SparkSession, root: str, day: dt.date) -> DataFrame:
    return measures(spark.read.parquet(f"{root}/as_of={day}"))
