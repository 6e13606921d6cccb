import datetime as dt

from pyspark.sql import functions as F

from tidemark import functions as fn


def values(df, column):
    return [row[column] for row in df.collect()]


def test_json_is_read_strict_first_then_repaired(spark):
    df = spark.createDataFrame([(1, '{"theme": "dark: blue"}'), (2, "{theme: dark}"), (3, None), (4, "not json"), (5, '{"theme": true}'), (6, "{}")], "id int, j string")
    out = df.select("id", fn.json_text("j", "theme").alias("v")).orderBy("id")
    assert values(out, "v") == ["dark: blue", "dark", None, None, "true", None]


def test_carrier_text_keeps_ampersand_and_spaces(spark):
    df = spark.createDataFrame([("{network_carrier: AT&T Mobility, x: 1}",), ('{"network_carrier": "Orange"}',)], "j string")
    assert values(df.select(fn.json_text("j", "network_carrier", "phrase").alias("v")), "v") == ["AT&T Mobility", "Orange"]


def test_distinct_list_is_sorted_and_null_when_empty(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (2, None), (3, "")], "k int, v string")
    out = df.groupBy("k").agg(fn.distinct_list("v").alias("v")).orderBy("k")
    assert values(out, "v") == ["a, b", None, ""]


def test_flags_ratios_and_numbers(spark):
    df = spark.createDataFrame([(None, 0.0, "x"), (True, 2.0, "1.5"), (False, None, "NaN")], "b boolean, d double, s string")
    out = df.select(fn.flag(F.col("b")).alias("f"), fn.guarded_ratio(F.lit(1.0), "d").alias("r"), fn.to_number("s").alias("n"))
    assert [tuple(r) for r in out.collect()] == [(0, 0.0, None), (1, 0.5, 1.5), (0, 0.0, None)]


def test_rounding_half_up_and_half_even(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.135,)], "v double")
    out = df.select(fn.half_up("v", 2).alias("up"), fn.half_even("v", 2).alias("even"))
    assert [tuple(r) for r in out.collect()] == [(0.13, 0.12), (2.68, 2.68), (0.14, 0.14)]


def test_agent_rules_first_match_wins(spark):
    df = spark.createDataFrame([("Windows Android",), ("Macintosh",), ("iPhone",), (None,)], "ua string")
    rules = (("Android", "Android"), ("iPhone", "IOS"), ("Windows", "WEB"))
    assert values(df.select(fn.contains_rules("ua", rules, "UNKNOWN").alias("p")), "p") == ["Android", "UNKNOWN", "IOS", "UNKNOWN"]


def test_seconds_lookup_and_routes(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start, start + dt.timedelta(milliseconds=1500), "USD", "/app/team-room"), (start, None, None, "/")],
                               "a timestamp_ntz, b timestamp_ntz, c string, r string")
    out = df.select(fn.seconds_between("a", "b").alias("s"), fn.lookup("c", {"USD": 84.0}, 1.0).alias("x"), fn.route_screen("r").alias("screen"))
    assert [tuple(r) for r in out.collect()] == [(1.5, 84.0, "TEAM_ROOM"), (None, 1.0, "HOME")]


def test_rounding_and_repair_leave_odd_values_alone(spark):
    row = spark.range(1).select(fn.half_up(F.lit(1e30), 2).alias("big"), fn.half_up(F.lit(2.345), 2).alias("tie"),
                                fn.json_text(F.lit('{"a": "x: y"}'), "b").alias("absent"), fn.json_text(F.lit("{theme: dark}"), "theme").alias("loose")).first()
    assert (row["big"], row["tie"], row["absent"], row["loose"]) == (1e30, 2.35, None, "dark")
