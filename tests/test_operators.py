import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters, intervals, joins, mutation, profiles, quality, survival

D = dt.date
T = dt.datetime


@pytest.fixture
def states(spark):
    rows = [(1, 1, "TRIAL", T(2024, 1, 1, 8)), (1, 2, "ACTIVE", T(2024, 1, 1, 9)), (1, 3, "PAUSED", T(2024, 1, 3)), (1, 5, "ACTIVE", T(2024, 1, 3)),
            (1, 6, "CANCELLED", T(2024, 1, 6)), (2, 7, "ACTIVE", T(2024, 1, 9)), (2, 8, "PAUSED", T(2024, 1, 20)), (3, 9, "ACTIVE", T(2024, 2, 1))]
    return spark.createDataFrame(rows, "sub long, state_id long, state string, at timestamp_ntz")


def test_same_day_changes_leave_only_the_last_and_future_states_no_days(states):
    as_of = D(2024, 1, 10)
    spans = intervals.state_intervals(states, "sub", "at", "state_id", "state", as_of)
    days = intervals.interval_days(spans, as_of)
    got = [tuple(r) for r in days.groupBy("sub", "state").agg(F.count("*"), F.min("activity_date"), F.max("activity_date")).orderBy("sub", "state").collect()]
    assert got == [(1, "ACTIVE", 5, D(2024, 1, 1), D(2024, 1, 5)), (1, "CANCELLED", 5, D(2024, 1, 6), D(2024, 1, 10)), (2, "ACTIVE", 2, D(2024, 1, 9), D(2024, 1, 10))]
    counted = {(r["sub"], r["state"]): r["days"] for r in intervals.interval_day_counts(spans, ["sub", "state"], as_of).collect()}
    assert counted == {(s, name): n for s, name, n, _, _ in got}


def test_interval_plan_has_no_nested_loop(states):
    days = intervals.interval_days(intervals.state_intervals(states, "sub", "at", "state_id", "state", D(2024, 1, 10)), D(2024, 1, 10))
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_left_join_many_keeps_lonely_rows_and_fans_out(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    many = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "k int, y int")
    got = sorted(joins.left_join_many(one, many, ["k"]).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, "a", 10), (1, "a", 11), (2, "b", None), (None, "c", None)], key=str)


def test_scalar_lookup_fails_on_duplicate_keys_only_when_hit(spark):
    df = spark.createDataFrame([("d1",), ("d2",), (None,)], "device string")
    table = spark.createDataFrame([("d1", "m1"), ("d9", "x"), ("d9", "y")], "device_id string, model string")
    out = joins.scalar_lookup(df, table, "device", "device_id", {"found": "model"})
    assert {r["device"]: r["found"] for r in out.collect()} == {"d1": "m1", "d2": None, None: None}
    hit = joins.scalar_lookup(spark.createDataFrame([("d9",)], "device string"), table, "device", "device_id", {"found": "model"})
    with pytest.raises(Exception, match="not unique"):
        hit.collect()


def test_upsert_keeps_timestamp_and_unmapped_columns(spark):
    base = spark.createDataFrame([("1", 10.0, T(2024, 1, 1), "APPROVED"), ("2", 20.0, T(2024, 1, 1), None)], "id string, v double, at timestamp_ntz, status string")
    batch = spark.createDataFrame([("1", None), ("3", 30.0)], "id string, v double")
    now = F.lit(T(2024, 2, 2))
    got = {r["id"]: tuple(r)[1:] for r in mutation.upsert(base, batch, "id", ["id", "v"], now, "at").collect()}
    assert got == {"1": (None, T(2024, 1, 1), "APPROVED"), "2": (20.0, T(2024, 1, 1), None), "3": (30.0, T(2024, 2, 2), None)}
    touched = {r["id"]: r["at"] for r in mutation.upsert(base, batch, "id", ["v"], now, "at", touch_timestamp=True).collect()}
    assert touched == {"1": T(2024, 2, 2), "2": T(2024, 1, 1), "3": T(2024, 2, 2)}


def test_last_update_wins_and_unknown_keys_are_ignored(spark):
    base = filters.with_audit_columns(spark.createDataFrame([("1",), ("2",)], "id string"))
    updates = spark.createDataFrame([("1", 1, "BLOCKED"), ("1", 2, "APPROVED"), ("9", 1, "BLOCKED")], "id string, no int, audit_action_status string")
    got = {r["id"]: r["audit_action_status"] for r in mutation.keyed_update(base, updates, "id", ["audit_action_status"], "no").collect()}
    assert got == {"1": "APPROVED", "2": "PENDING_REVIEW"}
    assert tuple(mutation.update_counts(base, updates, "id").first()) == (3, 2)


def test_filters(spark):
    df = spark.createDataFrame([("1", "USD", 5.0, 1), ("2", "EUR", None, 0), ("3", None, 2.5, 0)], "id string, currency string, v double, churned int")
    ids = lambda x: sorted(r["id"] for r in x.collect())
    assert ids(filters.search_any(df, "us")) == ["1"] and ids(filters.search_any(df, "")) == ["1", "2", "3"]
    assert ids(filters.search_any(df, "none")) == [] and ids(filters.search_any(df, "2.5", literal=True)) == ["3"]
    assert ids(filters.numeric_rules(df, {"v": ("between", 6, 2)})) == ["1", "3"]
    assert ids(filters.choose(df, {"currency": [], "region": ["x"]})) == ["1", "2", "3"]
    assert ids(filters.binary_flag(df, "churned", [0])) == ["2", "3"]
    assert filters.only_approved(df).count() == 0
    assert quality.status_violations(df.withColumn("audit_action_status", F.when(F.col("id") == "1", "APPROVED"))).count() == 2


def test_bins_are_right_closed_with_duplicate_edges_dropped(spark):
    df = spark.createDataFrame([(0.0, 0)] * 6 + [(1.0, 1), (2.0, 1), (3.0, 0), (4.0, 1)], "v double, y int")
    rows = profiles.rate_by_bin(df, "v", "y", 5).orderBy("bin").collect()
    frame = df.toPandas()
    expected = frame.groupby(pd.qcut(frame.v, 5, duplicates="drop"), observed=True).y.agg(["size", "mean"]).reset_index(drop=True)
    assert [(r["rows_in_bin"], r["label_rate"]) for r in rows] == [tuple(x) for x in expected.itertuples(index=False)]


def test_zero_against_active_counts_empty_groups_as_zero(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (None, 1)], "c int, y int")
    row = profiles.zero_against_active(df, ["c"], "y").first()
    assert row["active_rate"] == 0.0 and row["zero_rate"] == pytest.approx(2 / 3) and row["lift"] == 0.0


def test_latency_tier_of_missing_value(spark):
    df = spark.createDataFrame([(200.0,), (200.1,), (1500.1,), (None,)], "w double")
    assert [r[0] for r in df.select(profiles.latency_tier("w")).collect()] == ["Fast (<200ms)", "Degraded (200ms-1.5s)", "Catastrophic (>1.5s)", "Degraded"]


def test_survival_ties_extinction_and_cohort_without_events(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("b", 2, 0), ("b", 4, 0)], "c string, t int, e int")
    rows = survival.kaplan_meier(df, "c", "t", "e").orderBy("cohort", "t").collect()
    assert [(r["cohort"], r["t"], r["at_risk"], r["deaths"]) for r in rows] == [("a", 1, 4, 1), ("a", 2, 2, 1), ("a", 3, 1, 1), ("b", 2, 2, 0), ("b", 4, 1, 0)]
    assert [r["survival"] for r in rows] == pytest.approx([0.75, 0.375, 0.0, 1.0, 1.0])
    s, g = 0.75, 1 / (4 * 3)
    assert rows[0]["lower"] == pytest.approx(math.exp(-math.exp(math.log(-math.log(s)) - 1.959963984540054 * math.sqrt(g) / math.log(s))))
    assert all(r["lower"] <= r["survival"] <= r["upper"] for r in rows)


def test_correlation_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (3.0, 5.0, 0.0)], "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in profiles.correlations(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["a", "c"] == pytest.approx(-1.0) and got["a", "a"] == pytest.approx(1.0)


def test_quality_reports(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a int, lifetime_b string")
    assert quality.duplicate_rows(df).first()[0] == 1
    assert {r["column_name"]: r["null_count"] for r in quality.null_counts(df).collect()} == {"a": 0, "lifetime_b": 1}
    assert quality.strip_token(df).columns == ["a", "b"]
    assert quality.safe_name("range_<1M[x]>") == "range_lt_1M_x_gt_"
    assert [tuple(r) for r in quality.align_columns(df, ["z", "a"]).collect()] == [(0.0, 1), (0.0, 1), (0.0, 2)]
    assert quality.require_unique(df, ["a"]).count() == 1
