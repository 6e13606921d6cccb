"""Pairwise moments: equal to a plain computation, in one scan, whatever the partitions and the gaps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.moments import pairwise_correlations, pairwise_moments


@pytest.fixture(scope="module")
def frame(spark):
    random = np.random.default_rng(21)
    f = pd.DataFrame(random.normal(size=(4000, 6)), columns=list("abcdef"))
    f["b"] = f["a"] * 2 + f["b"] * 0.1
    f["c"] = 1e9 + f["c"]                 # a mean far above the spread
    f["d"] = 7.25                         # constant
    for name, share in (("b", 0.3), ("e", 0.6), ("f", 0.999)):
        f.loc[random.random(4000) < share, name] = np.nan
    df = spark.createDataFrame(f).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in f])
    return f, df


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_correlations_equal_brute_force(frame, parts):
    f, df = frame
    expected = f.corr()
    for row in pairwise_correlations(df.repartition(parts), list(f)).collect():
        want = expected.loc[row["feature_a"], row["feature_b"]]
        assert row["corr"] is None if np.isnan(want) else row["corr"] == pytest.approx(want, abs=1e-7)


def test_moments_of_a_pair(frame):
    f, df = frame
    both = f[["b", "e"]].dropna()
    row = pairwise_moments(df.repartition(5), ["b", "e"]).filter("a = 0 AND b = 1").first()
    centred = both - both.mean()
    assert (row["n"], row["c"], row["va"]) == (len(both), pytest.approx((centred.b * centred.e).sum()), pytest.approx((centred.b ** 2).sum()))


def test_one_scan_and_no_row_moves(spark, frame):
    _, df = frame
    path_df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = pairwise_correlations(path_df, ["l_quantity", "l_tax", "l_discount"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "l_shipdate" not in plan
    assert pairwise_moments(df.repartition(4), list("abc")).agg(F.max("n")).first()[0] == 4000


def test_odd_values_are_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, float("nan")), (3.0, 4.0), (None, 1.0), (float("inf"), 0.0), (4.0, 9.0)], "x double, y double")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in pairwise_correlations(df, ["x", "y"]).collect()}
    assert got["x", "y"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 4, 9])[0, 1]) and got["x", "x"] == pytest.approx(1.0)
    assert [r["corr"] for r in pairwise_correlations(df.limit(0), ["x", "y"]).collect()] == [None] * 3
