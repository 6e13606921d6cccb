"""The state per user: increments equal a full build, and a day reads its own partitions only."""

import datetime as dt
import functools

import pytest
from pyspark.sql import functions as F

from tidemark.catalogue.standin import AS_OF, raw_tables
from tidemark.plans import incremental as inc
from tidemark.plans import warehouse as wh
from tidemark.sources.readers import read_layer
from tidemark.sources.sinks import write_layer


def rows(df, columns):
    return sorted([[round(v, 7) if isinstance(v, float) else v for v in r] for r in df.select(*columns).collect()], key=str)


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    """Daily tables of the smallest stand-in, timelines stopping at the cancellation so that final days differ."""
    path = str(tmp_path_factory.mktemp("layer"))
    raw = raw_tables(spark, "/root/testdata/sf0.001")
    built = wh.build_all(raw, AS_OF, stop_at_cancel=True)
    write_layer({n: built[n] for n in inc.DAILY_TABLES}, path, {n: [wh.DAY] for n in inc.DAILY_TABLES})
    facts = read_layer(spark, path, list(inc.DAILY_TABLES))
    full = wh.behaviour_from_facts(wh.subscription_intervals(raw, AS_OF, True), *[facts[n] for n in inc.DAILY_TABLES[1:]], AS_OF)
    return path, facts, full.cache()


def test_increments_equal_a_full_build(spark, layer, tmp_path):
    path, facts, full = layer
    assert full.select("final_active_date").distinct().count() > 3
    root = str(tmp_path / "state")
    first = AS_OF - dt.timedelta(days=9)
    inc.build_state(spark, path, root, first)
    for step in range(1, 10):
        inc.advance_state(spark, path, root, first + dt.timedelta(days=step))
    columns = [c for c in full.columns]
    got = inc.read_measures(spark, root, AS_OF)
    assert got.columns == columns
    assert rows(got, columns) == rows(inc.measures(inc.state_of(inc.user_days(*facts.values()))), columns) == rows(full, columns)
    inc.advance_state(spark, path, root, AS_OF)      # a retry
    assert rows(inc.read_measures(spark, root, AS_OF), columns) == rows(full, columns)
    state = spark.read.parquet(f"{root}/as_of={AS_OF}")
    assert state.agg(F.max(F.size("recent"))).first()[0] <= 31 < state.agg(F.max("days")).first()[0]


def test_states_merge_in_any_grouping(layer):
    _, facts, _ = layer
    days = inc.user_days(*facts.values()).cache()
    cuts = [AS_OF - dt.timedelta(days=n) for n in (25, 3)]
    parts = [inc.state_of(d) for d in (days.filter(F.col(wh.DAY) <= cuts[0]), days.filter((F.col(wh.DAY) > cuts[0]) & (F.col(wh.DAY) <= cuts[1])), days.filter(F.col(wh.DAY) > cuts[1]))]
    whole = inc.measures(inc.state_of(days))
    for merged in (functools.reduce(inc.merge, parts), inc.merge(parts[0], inc.merge(parts[1], parts[2]))):
        assert rows(inc.measures(merged), whole.columns) == rows(whole, whole.columns)


def test_a_day_reads_its_own_partitions(spark, layer):
    path, _, _ = layer
    plan = inc._one_day(spark, path, AS_OF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) >= 4 and all(f"({wh.DAY}#" in s and "PartitionFilters: []" not in s for s in scans)


def test_days_lie_in_partitions_that_follow_the_subscriptions(layer):
    """Wide rows of quiet days shuffle to little: their partitions are as many as the subscriptions ask for, and are not merged."""
    _, facts, full = layer
    assert inc.partitions_for(0) == 1 and inc.partitions_for(100 * inc.SUBSCRIPTIONS_PER_PARTITION) == 101
    days = inc.user_days(*facts.values(), 9)
    assert days.rdd.getNumPartitions() == 9
    state = inc.state_of(days, 9)
    assert state.rdd.getNumPartitions() == 9 and inc.merge(state, state).rdd.getNumPartitions() == 9
    assert rows(inc.measures(state), full.columns) == rows(full, full.columns)
