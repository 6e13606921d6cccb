import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import box_negatives as b

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """Every anchor against every row; rows as in SCHEMA, in any order."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows
            if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (anchor, a, label) in enumerate(kept):
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, g) for k, (i, v, g) in enumerate(kept) if k != at)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(anchor, p, k + 1, i, -s, -n) for k, (n, i, _) in enumerate(fit[:negatives])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(seed, n, dims=8, labels=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.3 * (i % labels == d), 0.4) for d in range(dims)], i % labels) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"leaf": 4, "tree_bytes": 600, "block": 3}])
def test_equals_brute_force(spark, options):
    rows = vectors(1, 400)
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(60)]    # a group of copies with several labels
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(b.mine(df, F.expr("vec_id % 10 = 0"), **options)) == brute(rows, lambda i: i % 10 == 0)


def test_nothing_that_grows_is_broadcast(spark):
    """Blocks copied to all cells look as small as the blocks; they must not be gathered on the driver."""
    rows = vectors(5, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")    # fails at the first broadcast, also in jobs that run before the result's
    try:
        found = b.mine(df, F.expr("vec_id % 10 = 0"), leaf=4, tree_bytes=600, block=3)
        assert got(found) == brute(rows, lambda i: i % 10 == 0)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_block_is_copied_once_per_cell(spark, monkeypatch):
    """Cells grow far slower than trees; where a cell holds several trees the result is the same."""
    assert [b.parts_of(n) for n in (0, 1, 64, 65, 2048, 2049, 6400)] == [1, 1, 64, 64, 64, 65, 200]
    monkeypatch.setattr(b, "PARTS", 3)
    rows = vectors(6, 500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    trees = b.plant(b.quantised(df.select(F.col("vec_id").alias("row"), "vec_id", F.col("label").cast("long"), "embedding"), 256), [0, 1, 2], 8, 20, 4)
    parts = [r.part for r in trees.select("part").collect()]
    assert len(parts) > 9 and max(parts) < 3
    assert got(b.mine(df, F.expr("vec_id % 10 = 0"), leaf=4, tree_bytes=320, block=3)) == brute(rows, lambda i: i % 10 == 0)


def test_edges(spark):
    rows = vectors(2, 40, 3, 2) + [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [float("nan"), 1.0, 1.0], 0), (103, [float("inf"), 0.0, 0.0], 0),
                                   (104, [0.5, 0.5, 0.5], None), (None, [0.5, 0.5, 0.5], 1), (105, [0.0, 0.0, 0.0], 1), (106, [-1.0, -1.0, -1.0], 7), (20, [0.4, 0.1, 0.2], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clashing = df.withColumns({c: F.lit("x") for c in ("row", "vector", "block", "slot", "score", "rank", "anchor_id", "part")})
    assert got(b.mine(clashing, F.expr("vec_id % 5 = 0"))) == brute(rows, lambda i: i % 5 == 0)
    assert got(b.mine(df.limit(0), F.expr("vec_id % 5 = 0"))) == []
    assert got(b.mine(df, F.expr("vec_id < 0"))) == []
    short = [(0, [1.0, 1.0], 0), (1, [1.0, 1.0, 5.0], 0), (2, [0.9], 1), (3, [0.8, 0.8], 1), (4, [], 1)]
    padded = [(i, v + [0.0] * (3 - len(v)), g) for i, v, g in short]
    assert got(b.mine(spark.createDataFrame(short, SCHEMA), F.expr("vec_id = 0"))) == brute(padded, lambda i: i == 0) != []


def test_large_components_use_whole_numbers(spark):
    rows = [(i, [float(1 << 18) + i, float(i * 3)], i % 2) for i in range(30)]
    assert got(b.mine(spark.createDataFrame(rows, SCHEMA), F.expr("vec_id % 5 = 0"))) == brute(rows, lambda i: i % 5 == 0)
    with pytest.raises(Exception, match="64 bits"):
        b.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], SCHEMA), F.expr("vec_id = 0")).collect()


def tree_of(points, labels, leaf=16, fan=4):
    ids = np.arange(len(points))
    return b.build_tree(ids, ids, np.array(labels), points, [0, 1, 2], leaf, fan)


def test_boxes_hold_their_rows():
    rng = np.random.default_rng(3)
    points, labels = rng.integers(-200, 200, (700, 5)), rng.integers(0, 6, 700)
    packed = tree_of(points, labels)
    full = np.column_stack([packed["vectors"], packed["labels"]])
    assert sorted(packed["rows"]) == list(range(700)) and max(np.diff(packed["levels"][0][0])) <= 16
    spans = [(a, z) for a, z in zip(packed["levels"][0][0], packed["levels"][0][0][1:])]
    for starts, low, high in packed["levels"]:
        if len(starts) - 1 != len(spans):
            spans = [(spans[a][0], spans[z - 1][1]) for a, z in zip(starts, starts[1:])]
        for k, (a, z) in enumerate(spans):
            assert (full[a:z].min(axis=0) == low[k]).all() and (full[a:z].max(axis=0) == high[k]).all()
    assert spans == [(0, 700)]


def test_the_queue_skips_boxes():
    """Well separated clusters: most boxes stay closed, with the same result as a scan."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (20, 6))
    points, labels = centres[np.arange(2000) % 20] + rng.integers(-20, 20, (2000, 6)), np.arange(2000) % 20
    tree, anchor = b.Tree(tree_of(points, labels), np.float64), centres[3].astype(float)
    tree.bounds(anchor[None])
    for same, want in ((True, labels == 3), (False, labels != 3)):
        stats = [0]
        found = tree.search(0, anchor, 3, -1, [[-2**62, 2**62, -2**62, 5]], same, stats)[0]
        scores = points @ centres[3]
        assert found == sorted((-int(scores[i]), i) for i in np.flatnonzero(want))[:5]
        assert stats[0] < sum(len(level[1]) for level in tree.levels) / 3
