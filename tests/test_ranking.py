import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_quantiles, _in_pieces, numbered, running_totals

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value and one group holds most rows."""
    random = np.random.default_rng(7)
    frame = pd.DataFrame({"g": random.choice(["big", "big", "big", "small"], 30_000), "v": random.exponential(10, 30_000), "w": random.integers(0, 5, 30_000)})
    frame.loc[random.random(30_000) < 0.35, "v"] = 0.0
    frame.loc[5, "v"] = np.nan
    return frame, spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_quantiles_equal_brute_force(skewed):
    frame, df = skewed
    for row in exact_quantiles(df, ["v", "w"], PROBS, ["g"]).collect():
        expected = frame[frame.g == row["g"]][row["feature"]].quantile(PROBS)
        assert [row[f"q{i}"] for i in range(len(PROBS))] == pytest.approx(list(expected), rel=1e-12)
    for row in exact_quantiles(df, ["v"], PROBS).collect():
        assert [row[f"q{i}"] for i in range(len(PROBS))] == pytest.approx(list(frame["v"].quantile(PROBS)), rel=1e-12)


def test_quantiles_of_tiny_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0), ("c", 2.0), (None, 5.0)], "g string, v double")
    got = {row["g"]: row["q0"] for row in exact_quantiles(df, ["v"], [0.5], ["g"]).collect()}
    assert got == {"a": 1.0, "c": 1.5, None: 5.0}
    assert exact_quantiles(df.limit(0), ["v"], [0.5]).count() == 0


def test_quantiles_equal_the_built_in_aggregate(spark, skewed):
    _, df = skewed
    df = df.withColumn("v", F.when(F.rand(3) < 0.02, F.lit(float("nan"))).when(F.rand(4) < 0.02, F.lit(float("inf"))).otherwise(F.col("v")))
    df = df.persist()
    wanted = df.filter(~F.isnan("v")).groupBy("g").agg(F.percentile("v", [0.1, 0.5, 0.9]).alias("q")).collect()
    got = {row["g"]: [row["q0"], row["q1"], row["q2"]] for row in exact_quantiles(df, ["v"], [0.1, 0.5, 0.9], ["g"]).collect()}
    assert got == {row["g"]: pytest.approx(row["q"]) for row in wanted}
    df.unpersist()


def test_no_window_holds_a_whole_group(spark, skewed):
    """One value group is cut into as many pieces as there are partitions; ordered windows are per piece."""
    _, df = skewed
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        distinct = df.groupBy("v").count()
        pieces = _in_pieces(distinct, "v").groupBy("__piece").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(pieces) == 4 and max(p["count"] for p in pieces) < 0.4 * distinct.count()


def test_only_brackets_are_moved_and_ordered(spark):
    """Of 400 000 distinct values per group, a few hundred reach the shuffle after the sketch and the window."""
    df = spark.range(800_000, numPartitions=6).select((F.col("id") % 2).alias("g"), F.xxhash64("id").cast("double").alias("v"))
    wanted = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.99]).alias("q")).collect()}
    found = exact_quantiles(df, ["v"], [0.25, 0.5, 0.99], ["g"])
    assert {r["g"]: [r["q0"], r["q1"], r["q2"]] for r in found.collect()} == {g: pytest.approx(q, rel=1e-14) for g, q in wanted.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Checkpoint" not in plan and "ExistingRDD" not in plan
    windows, sizes = [], []

    def walk(node, below_window):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), below_window)
        if "QueryStage" in node.nodeName():
            return walk(node.plan(), below_window)
        if node.nodeName() == "Exchange" and below_window:
            return sizes.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.nodeName() == "Window":
            windows.append(node)
        for i in range(node.children().size()):
            walk(node.children().apply(i), below_window or node.nodeName() == "Window")

    walk(found._jdf.queryExecution().executedPlan(), False)
    assert len(windows) == len(sizes) == 1 and sizes[0] < 0.01 * 800_000


def test_null_order_is_refused(spark):
    with pytest.raises(Exception, match="v is NULL"):
        running_totals(spark.createDataFrame([(1.0, 2), (None, 3)], "v double, n long"), "v", ["n"]).collect()


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_brute_force(skewed, descending):
    frame, df = skewed
    counts = df.dropna(subset=["v"]).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {row["v"]: row["cum_n"] for row in running_totals(counts, "v", ["n"], descending).collect()}
    expected = frame["v"].dropna().value_counts().sort_index(ascending=not descending).cumsum()
    assert got == expected.to_dict()


def test_numbers_are_a_permutation_within_each_group(skewed):
    frame, df = skewed
    ids = df.withColumn("id", F.monotonically_increasing_id())
    rows = numbered(ids, ["g"], F.xxhash64("id"), ["id"]).groupBy("g").agg(F.count("row_no").alias("n"), F.countDistinct("row_no").alias("d"), F.max("row_no").alias("m")).collect()
    assert {row["g"]: (row["n"], row["d"], row["m"] + 1) for row in rows} == {g: (n, n, n) for g, n in frame.g.value_counts().items()}
