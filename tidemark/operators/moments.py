"""Means, variances and co-moments of all pairs of columns over the rows that have both: one pass, whatever is missing.

A task keeps four matrices of its rows (shared counts, sums, squares and products where the partner is present), filled
batch by batch by matrix products. Values are shifted by the task's first one, so no digits are lost to a large mean, and
tasks are merged by their centred moments. What moves is columns x columns numbers per task, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-13     # a spread below this share of the mean is rounding


def pairwise_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per pair of column numbers ``a <= b``: n, centred co-moment ``c`` and squares ``va``, ``vb`` over rows that have both.

    NULL, NaN and infinite values are missing.
    """
    columns = list(columns)
    size = len(columns)
    first, second = np.triu_indices(size)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, known = np.zeros(size), np.zeros(size, bool)
        count, total, square, product = (np.zeros((size, size)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float, copy=False)
            present = np.isfinite(x)
            fresh = ~known & present.any(axis=0)
            shift[fresh] = x[present.argmax(axis=0)[fresh], fresh.nonzero()[0]]
            known |= fresh
            x, mask = np.where(present, x - shift, 0.0), present.astype(float)
            count += mask.T @ mask
            total += x.T @ mask
            square += (x * x).T @ mask
            product += x.T @ x
        n, sa, sb = count[first, second], total[first, second], total[second, first]
        some = n > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            values = {"ma": shift[first] + sa / n, "mb": shift[second] + sb / n, "c": product[first, second] - sa * sb / n,
                      "va": np.maximum(0, square[first, second] - sa * sa / n), "vb": np.maximum(0, square[second, first] - sb * sb / n)}
        yield pa.RecordBatch.from_arrays([pa.array(first[some].astype(np.int32)), pa.array(second[some].astype(np.int32)), pa.array(n[some]), *[pa.array(v[some]) for v in values.values()]],
                                         names=["a", "b", "n", *values])

    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    tasks = values.mapInArrow(gram, "a int, b int, n double, ma double, mb double, c double, va double, vb double")
    pair = Window.partitionBy("a", "b")       # one row per task
    means = {f"all_{m}": F.sum(F.col("n") * F.col(m)).over(pair) / F.sum("n").over(pair) for m in ("ma", "mb")}
    da, db = F.col("ma") - F.col("all_ma"), F.col("mb") - F.col("all_mb")
    merged = tasks.withColumns(means).groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.max("all_ma").alias("ma"), F.max("all_mb").alias("mb"), F.sum(F.col("c") + F.col("n") * da * db).alias("c"),
        F.sum(F.col("va") + F.col("n") * da * da).alias("va"), F.sum(F.col("vb") + F.col("n") * db * db).alias("vb"))

    def or_zero(square: str, mean: str):
        return F.when(F.col(square) <= F.col("n") * F.pow(F.col(mean) * TINY, 2), 0.0).otherwise(F.col(square))
    return merged.withColumns({"va": or_zero("va", "ma"), "vb": or_zero("vb", "mb")})


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair in column order, each pair over the rows that have both; NULL where one is constant."""
    columns = list(columns)
    pairs = df.sparkSession.createDataFrame([(i, j, columns[i], columns[j]) for i in range(len(columns)) for j in range(i, len(columns))],
                                            "a int, b int, feature_a string, feature_b string")
    corr = F.try_divide("c", F.sqrt("va") * F.sqrt("vb"))
    within = F.when(corr.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr)))
    found = pairwise_moments(df, columns).select("a", "b", within.alias("corr"))
    return pairs.join(found, ["a", "b"], "left").select("feature_a", "feature_b", "corr")
