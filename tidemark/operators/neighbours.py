"""Mutual information between continuous columns and a class by nearest neighbours, on sorted pieces.

For a row, the distance to its k-th nearest neighbour of the same class sets a radius, and the rows of any class strictly
inside it are counted (Ross 2014). In one dimension both are questions of order:

* the k neighbours lie among the k rows before and after in the class. Rows with equal value are one row with a count.
  Rows are range-partitioned by column, class and value; windows run inside a piece, and the 2k rows at either end of
  each piece (a halo) are ordered once more across pieces for those that look beyond their own;
* the rows inside a radius are a difference of two running counts. Radius ends and values are one ordered stream, cut
  into pieces whose counts give each piece its offset.

No window holds a class or a column; pieces follow the number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import _in_pieces, join_null_safe

NEIGHBOURS = 3


def digamma(x: Column) -> Column:
    """The digamma function of whole numbers from 1: recurrence to beyond 6, then the asymptotic series."""
    y = x + F.lit(6.0)
    inverse = 1.0 / (y * y)
    series = F.ln(y) - 0.5 / y - inverse * (F.lit(1 / 12) - inverse * (F.lit(1 / 120) - inverse * (F.lit(1 / 252) - inverse * F.lit(1 / 240))))
    return series - sum((1.0 / (x + F.lit(float(i))) for i in range(6)), F.lit(0.0))


def _with_neighbours(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Add ``near``: distance and count of the k distinct values before and after in the order of ``value``."""
    order = Window.partitionBy(*by).orderBy("value")
    sides = []
    for step in range(1, k + 1):
        for move in (F.lag, F.lead):
            sides.append(F.struct(F.abs(F.col("value") - move("value", step).over(order)).alias("far"), move("n", step).over(order).alias("n")))
    return rows.withColumn("near", F.array_sort(F.filter(F.array(*sides), lambda s: s["n"].isNotNull())))


def neighbour_distances(rows: DataFrame, by: Sequence[str], k: int = NEIGHBOURS) -> DataFrame:
    """``rows`` (the ``by`` columns, distinct ``value``, count ``n``) with ``radius``, the distance to the k-th nearest other row of the group.

    A group of fewer rows looks at all it has; the only row of a group has no radius.
    """
    by = list(by)
    pieces = _in_pieces(rows, *by, "value")
    own = [*by, "__piece"]
    inside = Window.partitionBy(*own)
    numbered = pieces.withColumns({"__no": F.row_number().over(inside.orderBy("value")), "__size": F.count(F.lit(1)).over(inside)})
    from_end = F.col("__size") - F.col("__no") + 1
    middle = _with_neighbours(numbered, own, k).filter((F.col("__no") > k) & (from_end > k))
    # at most 4k rows of each piece; a row within k of an end has all its neighbours among them
    halo = numbered.filter((F.col("__no") <= 2 * k) | (from_end <= 2 * k))
    ends = _with_neighbours(halo, by, k).filter((F.col("__no") <= k) | (from_end <= k))
    both = middle.unionByName(ends)
    totals = rows.groupBy(*by).agg(F.sum("n").alias("__all"))
    known = join_null_safe(both, totals, by)
    wanted = F.least(F.lit(k), F.col("__all") - 1)
    start = F.struct(F.when(F.col("n") - 1 >= wanted, F.lit(0.0)).cast("double").alias("far"), (F.col("n") - 1).alias("seen"))
    found = F.aggregate("near", start, lambda acc, s: F.struct(
        F.coalesce(acc["far"], F.when(acc["seen"] + s["n"] >= wanted, s["far"])).alias("far"), (acc["seen"] + s["n"]).alias("seen")))
    return known.select(*by, "value", "n", F.col("__all").alias("group_rows"), F.when(F.col("__all") > 1, found["far"]).alias("radius"))


def counts_inside(points: DataFrame, by: str, label: str) -> DataFrame:
    """``points`` with ``inside``: rows of any class whose value lies strictly within ``radius``; with radius 0, rows of that value."""
    zero = F.col("radius") == 0
    value, low, high = F.col("value"), F.col("value") - F.col("radius"), F.col("value") + F.col("radius")
    # place 1: a value; a mark at place 0 counts what is below its position, at place 2 also what is on it
    marks = points.select(by, F.inline(F.array(
        F.struct(value.alias("at"), F.lit(1).alias("place"), F.col("n").alias("count"), F.lit(None).cast("int").alias("side"), F.col(label).alias("of"), value.alias("value")),
        F.struct(F.when(zero, value).otherwise(low).alias("at"), F.when(zero, 0).otherwise(2).alias("place"), F.lit(0).cast("long").alias("count"), F.lit(0).alias("side"), F.col(label).alias("of"), value.alias("value")),
        F.struct(F.when(zero, value).otherwise(high).alias("at"), F.when(zero, 2).otherwise(0).alias("place"), F.lit(0).cast("long").alias("count"), F.lit(1).alias("side"), F.col(label).alias("of"), value.alias("value")))))
    pieces = _in_pieces(marks, by, "at", "place")
    sizes = pieces.groupBy(by, "__piece").agg(F.sum("count").alias("__held"))
    # per column one row per partition
    before = Window.partitionBy(by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "__piece", F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(by, "__piece").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = join_null_safe(pieces, offsets, [by, "__piece"]).withColumn("upto", F.col("__before") + F.sum("count").over(inside))
    ends = counted.filter("side IS NOT NULL").groupBy(by, "of", "value").agg(
        (F.max(F.when(F.col("side") == 1, F.col("upto"))) - F.max(F.when(F.col("side") == 0, F.col("upto")))).alias("inside"))
    return join_null_safe(points, ends.withColumnRenamed("of", label), [by, label, "value"])


def neighbour_information(df: DataFrame, columns: Sequence[str], label: str, k: int = NEIGHBOURS) -> DataFrame:
    """Mutual information (nats, not below 0) between each column and the label, one row per column.

    Rows with a missing value among the columns or without a label are left out, as are rows that are alone in their class.
    Values are taken as they are: no noise is added, so the result is the same in every run. Ties at distance 0 count.
    """
    full = df.filter(F.col(label).isNotNull())
    for name in columns:
        full = full.filter(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = full.select(F.col(label).alias("label"), F.inline(pairs)).groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("n"))
    points = neighbour_distances(rows, ["feature", "label"], k).filter("radius IS NOT NULL")
    counted = counts_inside(points, "feature", "label")

    def mean(value: Column) -> Column:
        return F.sum(F.col("n") * value) / F.sum("n")
    neighbours = F.least(F.lit(k), F.col("group_rows") - 1)
    score = digamma(F.sum("n")) + mean(digamma(neighbours)) - mean(digamma(F.col("group_rows"))) - mean(digamma(F.col("inside")))
    return counted.groupBy("feature").agg(F.greatest(F.lit(0.0), score).alias("information"))
