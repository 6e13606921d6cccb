"""Per-row feature contributions of the fitted model, whichever kind won.

For trees they are Shapley values with the training cover as background, for a linear model weight times distance from
the training mean: for every row they add up to the model's margin minus its expected margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaf_table(model) -> list[dict]:
    """Every leaf of the ensemble as its value and, per feature on its path, the interval that
    leads there and the share of training rows that takes those branches."""
    leaves: list[dict] = []
    votes = isinstance(model, RandomForestClassificationModel)

    def value(node) -> float:
        """A boosted tree adds its prediction, a tree of a forest the share of positives in its leaf."""
        if not votes:
            return node.prediction()
        counts = list(node.impurityStats().stats())
        return counts[1] / sum(counts)

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if not hasattr(node, "split") or node.subtreeDepth() == 0:
            leaves.append({"value": weight * value(node), "path": dict(path)})
            return
        feature, limit = node.split().featureIndex(), node.split().threshold()
        cover = node.impurityStats().count()
        low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
        for child, bounds in ((node.leftChild(), (low, min(high, limit))), (node.rightChild(), (max(low, limit), high))):
            ratio = child.impurityStats().count() / cover
            walk(child, weight, {**path, feature: (*bounds, share * ratio)})

    for tree, weight in zip(model.trees, model.treeWeights):
        walk(tree._java_obj.rootNode(), weight, {})
    return leaves


def expected_margin(leaves: Sequence[dict]) -> float:
    return sum(leaf["value"] * math.prod(share for _, _, share in leaf["path"].values()) for leaf in leaves)


def add_contributions(df: DataFrame, leaves: Sequence[dict], vector: str, size: int,
                      name: str = "contributions") -> DataFrame:
    """Add an array with one contribution per feature. The leaf table is of model size, not data
    size; rows go through in Arrow batches, with no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast([
        (leaf["value"], [(f, *bounds) for f, bounds in leaf["path"].items()]) for leaf in leaves])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def contributions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            rows = np.stack(batch.to_numpy())
            result = np.zeros((len(rows), size))
            for value, path in shared.value:
                inside = [((rows[:, f] > low) & (rows[:, f] <= high)).astype(float) for f, low, high, _ in path]
                for i, (feature, _, _, share) in enumerate(path):
                    # Coefficient k: all ways to take k other features from the row and the rest
                    # from the background.
                    mixes = [np.ones(len(rows))]
                    for j, (_, _, _, other_share) in enumerate(path):
                        if j != i:
                            mixes = [(mixes[k] * other_share if k < len(mixes) else 0.0)
                                     + (mixes[k - 1] * inside[j] if k else 0.0) for k in range(len(mixes) + 1)]
                    count = len(path)
                    mean = sum(mix * math.factorial(k) * math.factorial(count - 1 - k) for k, mix in enumerate(mixes))
                    result[:, feature] += value * (inside[i] - share) * mean / math.factorial(count)
            yield pd.Series(list(result))

    return df.withColumn(name, contributions(vector_to_array(F.col(vector))))


def linear_contributions(names: Sequence[str], weights: Sequence[float], means: Sequence[float]) -> Column:
    """Exact contributions of a linear model: weight times distance from the mean."""
    return F.array(*[F.lit(float(w)) * (F.col(f"`{n}`") - F.lit(float(m))) for n, w, m in zip(names, weights, means)])


def _ranked(contributions: str | Column, names: Sequence[str]) -> Column:
    """(contribution, negated position, name): orders by value, earlier features first among ties."""
    labels = F.array(*[F.lit(n) for n in names])
    values = F.col(contributions) if isinstance(contributions, str) else contributions
    return F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"), F.element_at(labels, i + 1).alias("name")))


def primary_driver(contributions: str | Column, names: Sequence[str]) -> Column:
    """Feature with the largest contribution; the first one among equals."""
    return F.array_max(_ranked(contributions, names))["name"]


def top_drivers(contributions: str | Column, names: Sequence[str], count: int = 3) -> Column:
    ordered = F.sort_array(_ranked(contributions, names), asc=False)
    return F.transform(F.slice(ordered, 1, count), lambda s: s["name"])


def bottom_anchors(contributions: str | Column, names: Sequence[str], count: int = 3) -> Column:
    ordered = F.sort_array(_ranked(contributions, names), asc=True)
    return F.transform(F.slice(ordered, 1, count), lambda s: s["name"])
