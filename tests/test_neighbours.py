"""Nearest-neighbour mutual information: equal to a plain version for any number of pieces."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.neighbours import digamma, neighbour_distances, neighbour_information


def psi(n):
    return -0.5772156649015329 + math.fsum(1 / i for i in range(1, int(n)))


def plain(values, labels, k=3):
    """All pairs of rows."""
    counts = {y: labels.count(y) for y in set(labels)}
    rows = [(v, y) for v, y in zip(values, labels) if counts[y] > 1]
    total = 0.0
    for i, (v, y) in enumerate(rows):
        own = sorted(abs(v - w) for j, (w, z) in enumerate(rows) if z == y and j != i)
        r = own[min(k, counts[y] - 1) - 1]
        m = sum(w == v if r == 0 else v - r < w < v + r for w, _ in rows)
        total += psi(min(k, counts[y] - 1)) - psi(counts[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    labels = [int(x) for x in rng.integers(0, 3, 500)] + [9] + [7, 7]     # a class of one row, a class of two
    near = [float(rng.normal(2.0 * y, 1.0)) for y in labels]
    ties = [float(rng.integers(0, 6)) if y else 0.0 for y in labels]
    noise = [float(x) for x in rng.normal(size=len(labels))]
    return labels, {"near": near, "ties": ties, "noise": noise}


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_equals_a_plain_version(spark, data, parts):
    labels, columns = data
    df = spark.createDataFrame(list(zip(labels, *columns.values())), "y int, near double, ties double, noise double")
    kept = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["feature"]: r["information"] for r in neighbour_information(df, list(columns), "y").collect()}
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert got == {name: pytest.approx(plain(values, labels), abs=1e-9) for name, values in columns.items()}
    assert got["near"] > 0.3 > got["noise"]


def test_distances(spark):
    rows = spark.createDataFrame([("a", 0.0, 1), ("a", 1.0, 2), ("a", 5.0, 1), ("a", 9.0, 5), ("b", 2.0, 1), (None, 1.0, 1), (None, 4.0, 1)], "g string, value double, n long")
    got = {(r["g"], r["value"]): r["radius"] for r in neighbour_distances(rows, ["g"], 3).collect()}
    assert got == {("a", 0.0): 5.0, ("a", 1.0): 4.0, ("a", 5.0): 4.0, ("a", 9.0): 0.0, ("b", 2.0): None, (None, 1.0): 3.0, (None, 4.0): 3.0}


def test_missing_values_and_digamma(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 0), (float("nan"), 1), (2.0, None), (1.5, 0), (3.0, 1), (3.5, 1)], "x double, y int")
    assert neighbour_information(df, ["x"], "y").first()["information"] == pytest.approx(plain([1.0, 1.5, 3.0, 3.5], [0, 0, 1, 1]))
    assert neighbour_information(df.limit(0), ["x"], "y").count() == 0
    for row in spark.range(1, 40).withColumn("p", digamma(F.col("id"))).collect():
        assert row["p"] == pytest.approx(psi(row["id"]), abs=1e-9)
