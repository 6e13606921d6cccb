"""Keyed tables with buckets and changes: equal to a plain fold, and untouched files stay untouched."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import keyed

SCHEMA = "k string, a int, b string, at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def rows_of(df):
    return {r["k"]: tuple(r)[1:] for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)


def files(path, below):
    return {f: f.stat().st_mtime_ns for f in (path / below).rglob("*.parquet")}


def test_random_commits_equal_a_plain_fold(spark, tmp_path):
    rng, table = random.Random(5), str(tmp_path / "t")
    held = {f"k{i}": (i, f"b{i}", T0) for i in range(40)}
    assert keyed.create(frame(spark, held), table, "k", 6) == 1
    with pytest.raises(FileExistsError):
        keyed.create(frame(spark, held), table, "k", 6)
    for turn in range(7):
        at = dt.datetime(2024, 2, 1 + turn)
        keys = rng.sample([f"k{i}" for i in range(60)], 9)
        if turn % 3 == 1:
            edits = [(rng.choice([*keys, "none"]), rng.choice([None, 100 + turn]), n) for n in range(15)]
            got = keyed.commit_update(spark.createDataFrame(edits, "k string, a int, n int"), table, ["a"], "n")
            assert got == {"submitted": 15, "matched": sum(k in held for k, _, _ in edits)}
            for k, a, _ in edits:
                if k in held:
                    held[k] = (a, *held[k][1:])
        else:
            batch = [(k, None if rng.random() < 0.3 else f"t{turn}") for k in keys]
            touch = turn == 6
            keyed.commit_upsert(spark.createDataFrame(batch, "k string, b string"), table, ["b"], F.lit(at), "at", touch)
            for k, b in batch:
                held[k] = (held[k][0], b, at if touch else held[k][2]) if k in held else (None, b, at)
        if turn == 4:
            keyed.compact(spark, table, 2)
        assert rows_of(keyed.read(spark, table)) == held
    assert keyed.compact(spark, table)
    assert rows_of(keyed.read(spark, table)) == held and keyed.compact(spark, table) == []
    assert not keyed.state_of(spark, table).changes_of()


def test_an_edit_and_its_compaction_touch_one_bucket(spark, tmp_path):
    table = str(tmp_path / "t")
    keyed.create(frame(spark, {f"k{i}": (i, "b", T0) for i in range(200)}), table, "k", 8)
    before = files(tmp_path / "t", "base")
    assert len({f.parent for f in before}) == 8
    assert keyed.commit_update(spark.createDataFrame([("k7", -1, 1)], "k string, a int, n int"), table, ["a"], "n") == {"submitted": 1, "matched": 1}
    assert files(tmp_path / "t", "base") == before and len(files(tmp_path / "t", "delta")) == 1
    touched = keyed.compact(spark, table)
    fresh = [f for f in files(tmp_path / "t", "base") if f not in before]
    assert len(touched) == 1 and {f.parent.name for f in fresh} == {f"bucket={touched[0]}"}
    assert {f: f.stat().st_mtime_ns for f in before} == before
    state = keyed.state_of(spark, table)
    assert sorted(set(state.bases.values())) == [1, 3] and rows_of(keyed.read(spark, table))["k7"] == (-1, "b", T0)
    # reading one bucket opens only its folder
    some = keyed.read(spark, table, touched)
    assert {f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()} == {str(touched[0])} and 0 < some.count() < 200


def test_commits_without_a_marker_do_not_exist(spark, tmp_path):
    table = str(tmp_path / "t")
    assert keyed.state_of(spark, table) is None
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, table)
    keyed.create(frame(spark, {}), table, "k", 4)
    assert keyed.read(spark, table).count() == 0
    frame(spark, {"x": (1, "b", T0)}).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table}/delta/c=2")    # a writer that died
    assert keyed.commit_update(spark.createDataFrame([("k7", -1, 1)], "k string, a int, n int"), table, ["a"], "n") == {"submitted": 1, "matched": 0}
    assert keyed.commit_upsert(spark.createDataFrame([("x", 5)], "k string, a int"), table, ["a"], F.lit(T0), "at") > 2
    assert rows_of(keyed.read(spark, table)) == {"x": (5, None, T0)}
