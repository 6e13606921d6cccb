"""Orderings over whole tables without a one-task window: running totals, exact quantiles, row numbers.

A window over one huge group sorts that group in one task, and ``percentile`` keeps every distinct value of a group in
one task's memory. For totals and numbers, rows are range-partitioned by group and value; a piece is what one partition
has of a group. Counts per piece give each its exact starting rank, and the exact work happens inside pieces. Their number
follows the number of partitions, so it grows with the data. Quantiles bracket the wanted ranks by a sketch and order the
values inside the brackets alone. One path serves every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Rank sketches: 1 / ACCURACY bounds their error as a share of the group; brackets reach SLACK to either side.
ACCURACY = 10_000
SLACK = 2.5 / ACCURACY


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join that also matches NULL keys; keeps the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])


def _in_pieces(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` range-partitioned in ``order`` with the number of each row's partition, written once so that it stays."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("__piece", F.spark_partition_id()))


def running_totals(df: DataFrame, order: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Add ``cum_<s>`` for each column in ``sums``: its total up to and including the row's value.

    Expects one row per value of ``order``: aggregate ties first. A NULL has no place in the order and fails the job.
    """
    direction = F.desc if descending else F.asc
    checked = df.withColumn(order, F.coalesce(F.col(order), F.raise_error(F.lit(f"{order} is NULL")).cast(df.schema[order].dataType)))
    pieces = _in_pieces(checked, direction(order))
    earlier = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition reaches this global window
    totals = pieces.groupBy("__piece").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    offsets = totals.select("__piece", *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__o_{s}") for s in sums])
    inside = Window.partitionBy("__piece").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = pieces.join(offsets, "__piece").withColumns({f"cum_{s}": F.col(f"__o_{s}") + F.sum(s).over(inside) for s in sums})
    return out.drop("__piece", *[f"__o_{s}" for s in sums])


def numbered(df: DataFrame, by: Sequence[str], key: Column, tie_break: Sequence[str], name: str = "row_no") -> DataFrame:
    """Exact row numbers (from 0) per group in the order of ``key``, also where one group holds most of the table."""
    pieces = _in_pieces(df.withColumn("__key", key), *by, "__key", *tie_break)
    sizes = pieces.groupBy(*by, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    # per group one row per partition
    before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__piece").orderBy("__key", *tie_break)
    out = join_null_safe(pieces, offsets, [*by, "__piece"])
    return out.withColumn(name, F.col("__before") + F.row_number().over(inside) - 1).drop("__key", "__piece", "__before")


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): ``feature``, ``value`` as double. Narrow, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (group, feature), columns ``q0, q1, ...``; NULL and NaN count for nothing.

    The first pass merges a rank sketch per group and feature. Its rank error is at most 1 / ``ACCURACY`` of the group, so
    the sketched values ``SLACK`` to either side of a wanted rank bracket it. The second pass counts what lies between
    brackets, per task, and moves only the values inside them: at most 2 x ``SLACK`` of the rows per quantile, plus ties,
    which are counted before they move. A rank outside its bracket would fail the job; it cannot be answered wrongly.
    Nothing is written and nothing runs before the caller's action.
    """
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    keys = [*by, "__feature"]
    pairs = F.array(*[F.struct(F.lit(j).alias("__feature"), F.col(c).cast("double").alias("__value")) for j, c in enumerate(columns)])
    long = df.select(*by, F.inline(pairs)).filter(F.col("__value").isNotNull() & ~F.isnan("__value"))

    order = sorted(range(len(probs)), key=probs.__getitem__)
    marks = [max(0.0, probs[i] - SLACK) for i in order] + [min(1.0, probs[i] + SLACK) for i in order]
    sketch = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"), F.percentile_approx("__value", marks, ACCURACY).alias("__marks"))
    # in a group of few rows one rank is more than the slack: its brackets are open
    few = F.col("__total") * SLACK < 10
    open_low, open_high = F.lit(float("-inf")), F.lit(float("inf"))
    lows = [F.when(few | F.lit(probs[i] <= SLACK), open_low).otherwise(F.col("__marks")[k]).alias(f"__low{k}") for k, i in enumerate(order)]
    highs = [F.when(few | F.lit(probs[i] >= 1 - SLACK), open_high).otherwise(F.col("__marks")[len(probs) + k]).alias(f"__high{k}") for k, i in enumerate(order)]
    brackets = sketch.select(*keys, "__total", *lows, *highs)
    # without groups there is one row per column; with groups the join is planned by their number
    joined = join_null_safe(long, brackets if by else F.broadcast(brackets), keys)
    value = F.col("__value")
    inside = reduce(or_, [(value >= F.col(f"__low{k}")) & (value <= F.col(f"__high{k}")) for k in range(len(probs))])
    passed = reduce(add, [(value > F.col(f"__high{k}")).cast("int") for k in range(len(probs))])
    # values between the same two brackets are one row; its greatest value keeps it in its place
    counts = joined.select(*keys, "__total", "__value", inside.alias("__inside"), passed.alias("__passed")).groupBy(
        *keys, "__total", F.when(F.col("__inside"), value).alias("__exact"), F.when(~F.col("__inside"), F.col("__passed")).alias("__gap")).agg(
        F.count(F.lit(1)).alias("__n"), F.max("__value").alias("__place"))
    inside_group = Window.partitionBy(*keys).orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = counts.withColumn("__upto", F.sum("__n").over(inside_group))

    position = lambda p: (F.col("__total") - 1) * F.lit(p)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(position(p)).alias("low"), F.ceil(position(p)).alias("high"),
                               (position(p) - F.floor(position(p))).alias("weight")) for i, p in enumerate(probs)])
    hit = lambda rank: (rank >= F.col("__upto") - F.col("__n")) & (rank < F.col("__upto"))
    found = F.coalesce("__exact", F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double"))
    picked = held.withColumn("__ranks", F.filter(ranks, lambda r: hit(r["low"]) | hit(r["high"]))).filter(F.size("__ranks") > 0)
    picked = picked.select(*keys, found.alias("__value"), "__n", "__upto", F.explode("__ranks").alias("r"))
    answers = picked.groupBy(*keys, F.col("r.i").alias("__i")).agg(
        F.max(F.when(hit(F.col("r.low")), F.col("__value"))).alias("__low"),
        F.max(F.when(hit(F.col("r.high")), F.col("__value"))).alias("__high"), F.max("r.weight").alias("__weight"))
    # equal neighbours are taken as they are: their difference is no number if both are infinite
    answer = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(
        F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__weight"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__feature") + 1)
    return answers.withColumn("__q", answer).groupBy(*by, names.alias("feature")).agg(
        *[F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(f"q{i}") for i in range(len(probs))])


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of whole columns as fit parameters; one short list per column reaches the driver."""
    rows = exact_quantiles(df, columns, probs).collect()
    return {row["feature"]: [row[f"q{i}"] for i in range(len(probs))] for row in rows}
