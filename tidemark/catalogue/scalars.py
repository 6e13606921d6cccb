"""Scalar expressions, flags, text and JSON, filters and data quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalogue.base import ORDERS_AS_OF, query, rounded, sql_round as r, table
from tidemark.functions import (
    contains_rules, fill_defaults, flag, guarded_ratio, half_even, half_up, hashed_id, json_text, lookup,
    normalise_email, period_sin_cos, present_flag, route_screen, slug, to_number,
)
from tidemark.operators import filters, quality
from tidemark.operators.intervals import date_spine
from tidemark.plans.dispatch import json_records, unwrap_records, wrap_records
from tidemark.sources.readers import parse_lines

LOOSE = r"""regexp_replace(props, '"', '', 'g')"""


@query("c3_json_repair", rf"""
WITH t AS (SELECT event_id, props, {LOOSE} AS loose FROM events),
f AS (SELECT event_id, props, regexp_replace(regexp_replace(loose, '([a-zA-Z0-9_]+)\s*:', '"\1":', 'g'), ':\s*([a-zA-Z0-9_]+)', ': "\1"', 'g') AS fixed FROM t)
SELECT event_id, json_extract_string(props, '$.k') AS strict_k, json_extract_string(fixed, '$.k') AS loose_k,
       json_extract_string(fixed, '$.missing') AS missing FROM f""")
def json_repair(spark, sf):
    events = table(spark, sf, "events").withColumn("loose", F.regexp_replace("props", '"', ""))
    return events.select("event_id", json_text("props", "k").alias("strict_k"), json_text("loose", "k").alias("loose_k"),
                         json_text("loose", "missing").alias("missing"))


@query("c11_date_spine", f"""
WITH spine AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), DATE '{ORDERS_AS_OF}', INTERVAL 1 DAY)) AS DATE) AS date_day)
SELECT date_day, count(o_orderkey) AS orders FROM spine LEFT JOIN orders ON CAST(o_orderdate AS DATE) = date_day GROUP BY date_day""")
def spine_with_counts(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date_day"))
    daily = orders.groupBy("date_day").agg(F.count("o_orderkey").alias("orders"))
    spine = date_spine(orders, "date_day", ORDERS_AS_OF)
    return fill_defaults(spine.join(daily, "date_day", "left"), {"orders": 0})


@query("c15_guarded_scalars", f"""
SELECT o_orderkey, {r('ln(1 + o_totalprice)')} AS log_price, {r('sin(2 * pi() * month(o_orderdate) / 12)')} AS month_sin,
       {r('cos(2 * pi() * month(o_orderdate) / 12)')} AS month_cos, greatest(month(o_orderdate) - 3, 1)::INTEGER AS at_least_one,
       least(o_custkey, 100) AS at_most_100, {r('abs(o_totalprice - 250000)')} AS distance,
       {r('CASE WHEN month(o_orderdate) = 1 THEN 0.0 ELSE o_totalprice / (month(o_orderdate) - 1) END')} AS ratio,
       CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS size,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ordered_at,
       CAST(o_orderdate AS DATE) - 7 AS week_before, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS INTEGER) AS age_days
FROM orders""")
def guarded_scalars(spark, sf):
    month = F.month("o_orderdate")
    sine, cosine = period_sin_cos(month, 12)
    price, day = F.col("o_totalprice"), F.to_date("o_orderdate")
    out = table(spark, sf, "orders").select(
        "o_orderkey", F.log1p(price).alias("log_price"), sine.alias("month_sin"), cosine.alias("month_cos"),
        F.greatest(month - 3, F.lit(1)).alias("at_least_one"), F.least("o_custkey", F.lit(100)).alias("at_most_100"),
        F.abs(price - 250000).alias("distance"), guarded_ratio(price, month - 1).alias("ratio"),
        F.when(price < 100000, "low").when(price < 300000, "mid").otherwise("high").alias("size"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ordered_at"), F.date_sub(day, 7).alias("week_before"),
        F.datediff(F.lit(ORDERS_AS_OF), day).alias("age_days"))
    return rounded(out, "log_price", "month_sin", "month_cos", "distance", "ratio")


@query("c7_roundings", f"""
SELECT o_orderkey, {r('o_totalprice', 0)} AS up_0, {r('o_totalprice', 1)} AS up_1,
       CAST(round_even(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS even_1 FROM orders""")
def roundings(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", half_up("o_totalprice", 0).alias("up_0"), half_up("o_totalprice", 1).alias("up_1"),
                                             half_even("o_totalprice", 1).alias("even_1"))


@query("c19_device_hash", """
SELECT c_custkey, substr(sha256(c_custkey || '|' || c_name || '|' || c_nationkey), 1, 32) AS device_id,
       lower(trim(c_name || '@EXAMPLE.com ')) AS email, regexp_replace(lower(c_name), '[^a-z0-9._]', '', 'g') AS slug FROM customer""")
def device_hash(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", hashed_id("c_custkey", "c_name", "c_nationkey").alias("device_id"),
        normalise_email(F.concat("c_name", F.lit("@EXAMPLE.com "))).alias("email"), slug("c_name").alias("slug"))


# Which component a screen event belongs to in this test mapping.
COMPONENTS = {"view": "screen", "click": "button", "purchase": "checkout", "signup": "form"}


@query("c21_route_to_screen", """
SELECT page_id, coalesce(nullif(upper(replace(list_extract(string_split(url, '/'), -1), '-', '_')), ''), 'HOME') AS screen FROM pages""")
def route_to_screen(spark, sf):
    return table(spark, sf, "pages").select("page_id", route_screen("url").alias("screen"))


@query("c22_event_component", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'screen' WHEN 'click' THEN 'button' WHEN 'purchase' THEN 'checkout' WHEN 'signup' THEN 'form' ELSE 'other' END AS component
FROM events""")
def event_component(spark, sf):
    return table(spark, sf, "events").select("event_id", lookup("event_type", COMPONENTS, "other").alias("component"))


@query("f1_flags_and_defaults", """
WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS p FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS positive, CASE WHEN p IS NOT NULL THEN 1 ELSE 0 END AS has_orders,
       coalesce(n, 0) AS orders, coalesce(p, 'NONE') AS priority, coalesce(p, c_mktsegment, 'Unknown') AS label
FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def flags_and_defaults(spark, sf):
    placed = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_orderpriority").alias("priority"))
    joined = table(spark, sf, "customer").join(placed, "c_custkey", "left").select(
        "c_custkey", flag(F.col("c_acctbal") > 0).alias("positive"), present_flag("priority").alias("has_orders"), "orders", "priority",
        F.coalesce("priority", "c_mktsegment", F.lit("Unknown")).alias("label"))
    return fill_defaults(joined, {"orders": 0, "priority": "NONE"})


@query("f6_ordered_like_rules", """
SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 'RED' WHEN p_name LIKE '%ring%' THEN 'RING' WHEN p_name LIKE '%bolt%' THEN p_brand ELSE 'UNKNOWN_PART' END AS kind FROM part""")
def ordered_like_rules(spark, sf):
    rules = [("red", "RED"), ("ring", "RING"), ("bolt", F.col("p_brand"))]
    return table(spark, sf, "part").select("p_partkey", contains_rules("p_name", rules, "UNKNOWN_PART").alias("kind"))


@query("f10_any_column_search", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE CAST(c_custkey AS VARCHAR) ILIKE '%77%' OR c_name ILIKE '%77%' OR c_mktsegment ILIKE '%77%'
UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE regexp_matches(CAST(c_custkey AS VARCHAR), '(?i)^auto|9{3}') OR regexp_matches(c_name, '(?i)^auto|9{3}') OR regexp_matches(c_mktsegment, '(?i)^auto|9{3}')""")
def any_column_search(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return filters.search_any(customers, "77", literal=True).unionByName(filters.search_any(customers, "^auto|9{3}"))


@query("f11_filters_combo", """
SELECT c_custkey, c_mktsegment, c_acctbal FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 100 AND 6000 AND c_custkey >= 10
  AND c_acctbal > 3000 AND c_nationkey % 3 <> 0 AND c_nationkey <= 20 AND c_custkey % 4 = 1""")
def filters_combo(spark, sf):
    reviewed = table(spark, sf, "customer").withColumns({
        "churned": flag(F.col("c_acctbal") > 3000), "quarter": F.col("c_custkey") % 4,
        "audit_action_status": F.when(F.col("c_nationkey") % 3 != 0, "approved").otherwise("BLOCKED")})
    chosen = filters.choose(reviewed, {"c_mktsegment": ["BUILDING", "MACHINERY"], "region": ["absent"], "c_name": []})
    ruled = filters.numeric_rules(chosen, {"c_acctbal": ("between", 6000, 100), "c_custkey": (">=", 10), "c_nationkey": ("<=", 20), "quarter": ("=", 1)})
    approved = filters.only_approved(filters.binary_flag(ruled, "churned", [1]))
    return approved.select("c_custkey", "c_mktsegment", "c_acctbal")


@query("f14_option_values", """
SELECT 'option' AS kind, p_type AS option, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::BOOLEAN AS whole FROM part WHERE p_type <> '' GROUP BY p_type
UNION ALL SELECT 'bounds', 'p_size', min(p_size), max(p_size), bool_and(p_size % 1 = 0) FROM part
UNION ALL SELECT 'bounds', 'p_retailprice', min(p_retailprice), max(p_retailprice), bool_and(p_retailprice % 1 = 0) FROM part""")
def option_values(spark, sf):
    parts = table(spark, sf, "part")
    options = filters.option_values(parts, "p_type").select(F.lit("option").alias("kind"), "option")
    bounds = filters.numeric_bounds(parts, ["p_size", "p_retailprice"]).withColumnRenamed("column_name", "option").withColumn("kind", F.lit("bounds"))
    return options.unionByName(bounds, allowMissingColumns=True)


@query("f19_route_by_type", """
SELECT event_type AS branch, count(*) AS events, count(DISTINCT user_id) AS users FROM events WHERE event_type IN ('purchase', 'error') GROUP BY event_type""")
def route_by_type(spark, sf):
    branches = filters.route(table(spark, sf, "events"), "event_type", ["purchase", "error"])
    counted = [rows.agg(F.lit(name).alias("branch"), F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))
               for name, rows in branches.items()]
    return counted[0].unionByName(counted[1])


@query("o2_recent_top_k", """
SELECT event_id, ts, user_id, event_type, value FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)""")
def recent_top_k(spark, sf):
    return filters.recent(table(spark, sf, "events").drop("props"), "ts", "event_id", 200)


@query("p3_duplicates", """
SELECT 'lineitem key' AS checked, (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS found
UNION ALL SELECT 'conversations rows', (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM conversations GROUP BY conv_id, turn, role, text))
UNION ALL SELECT 'null ' || name, n FROM (UNPIVOT (SELECT count(*) - count(conv_id) AS conv_id, count(*) - count(turn) AS turn, count(*) - count(role) AS role, count(*) - count(text) AS text FROM conversations)
  ON conv_id, turn, role, text INTO NAME name VALUE n)""")
def duplicates(spark, sf):
    lines, talks = table(spark, sf, "lineitem"), table(spark, sf, "conversations")
    keyed = quality.duplicate_rows(lines, ["l_orderkey", "l_linenumber"]).select(F.lit("lineitem key").alias("checked"), F.col("duplicate_rows").alias("found"))
    full = quality.duplicate_rows(talks).select(F.lit("conversations rows").alias("checked"), F.col("duplicate_rows").alias("found"))
    gaps = quality.null_counts(talks).select(F.concat(F.lit("null "), "column_name").alias("checked"), F.col("null_count").alias("found"))
    return keyed.unionByName(full).unionByName(gaps)


@query("p5_table_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, count({c}) AS filled_count FROM orders"
    for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                 ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))))
def table_profile(spark, sf):
    return quality.table_profile(table(spark, sf, "orders"))


@query("p8_try_numeric", r"""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS kind,
       TRY_CAST(regexp_replace(event_type, 'click', '12.5') AS DOUBLE) AS mixed FROM events""")
def try_numeric(spark, sf):
    typed = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind"),
                                              F.regexp_replace("event_type", "click", "12.5").alias("mixed"))
    return quality.coerce_numeric(typed, ["k", "kind", "mixed", "absent"])


@query("p9_rename_align", """
SELECT c_custkey AS "key", coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'Unknown') AS segment_lt_1M, c_acctbal AS "balance_x_", 0.0::DOUBLE AS absent FROM customer""")
def rename_align(spark, sf):
    odd = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("lifetime_key"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment_<1M"),
        F.col("c_acctbal").alias("lifetime_balance[x]"), F.col("c_name").alias("unwanted"))
    clean = quality.safe_names(quality.strip_token(quality.drop_unwanted(odd, "unwanted", "never_there")))
    filled = quality.fill_nulls(clean, {"segment_lt_1M": "Unknown"})
    return quality.align_columns(filled, ["key", "segment_lt_1M", "balance_x_", "absent"])


@query("p13_status_rule", """
SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'APPROVED' WHEN c_acctbal >= 0 THEN 'NOT_A_STATUS' END AS audit_action_status
FROM customer WHERE c_acctbal <= 9000""")
def status_rule(spark, sf):
    status = F.when(F.col("c_acctbal") > 9000, "APPROVED").when(F.col("c_acctbal") >= 0, "NOT_A_STATUS")
    return quality.status_violations(table(spark, sf, "customer").select("c_custkey", status.alias("audit_action_status")))


@query("s15_json_records", """
SELECT CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_acctbal': CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 'seen_at': '2024-01-31T00:00:00.000000'}) AS VARCHAR) AS record FROM customer""")
def records(spark, sf):
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    return json_records(table(spark, sf, "customer").select(
        "c_custkey", "c_name", balance.alias("c_acctbal"), F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz").alias("seen_at")))


@query("s17_wrapped_records", "SELECT c_custkey, c_acctbal FROM customer")
def wrapped_records(spark, sf):
    """Records to documents and back."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return unwrap_records(wrap_records(customers, "predictions"), "body", customers.schema)


@query("p7_null_indicators", """
SELECT c_custkey, c_acctbal IS NULL AS c_acctbal, note IS NULL AS note FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_name END AS note FROM customer)""")
def indicators(spark, sf):
    noted = table(spark, sf, "customer").withColumn("note", F.when(F.col("c_acctbal") > 0, F.col("c_name")))
    return quality.null_indicators(noted, ["c_acctbal", "note"], keep=["c_custkey"])


@query("p8_source_numbers", r"""
SELECT doc_id, TRY_CAST(substr(source, 4) AS DOUBLE) AS source_number FROM documents""")
def numbers_or_null(spark, sf):
    return table(spark, sf, "documents").select("doc_id", to_number(F.substring("source", 4, 10)).alias("source_number"))


@query("o3_first_rows", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def first_rows(spark, sf):
    return filters.first_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"])


@query("p10_columns_with", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, o_totalprice FROM orders")
def columns_with(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(*quality.columns_with(orders.columns, ["order", "price"]))


@query("q_readability", r"""
WITH e AS (SELECT CASE WHEN event_id % 7 = 0 THEN replace(props, '"', '') WHEN event_id % 11 <> 0 THEN props END AS props,
                  CASE WHEN event_id % 5 = 0 THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 8) ELSE '12345678-1234-1234-1234-' || substr(md5(CAST(event_id AS VARCHAR)), 1, 12) END AS uuid FROM events)
SELECT 'uuid' AS column_name, count(uuid) AS filled, count(*) FILTER (WHERE length(uuid) = 8) AS unreadable FROM e
UNION ALL SELECT 'props', count(props), count(*) FILTER (WHERE props IS NOT NULL AND NOT json_valid(props)) FROM e""")
def readability(spark, sf):
    number = F.md5(F.col("event_id").cast("string"))
    events = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 7 == 0, F.regexp_replace("props", '"', "")).when(F.col("event_id") % 11 != 0, F.col("props")).alias("props"),
        F.when(F.col("event_id") % 5 == 0, F.substring(number, 1, 8)).otherwise(F.concat(F.lit("12345678-1234-1234-1234-"), F.substring(number, 1, 12))).alias("uuid"))
    return quality.readability(events, ["uuid"], ["props"])


@query("q_fan_out", """
SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows, max(n) AS most, count(*) FILTER (WHERE n > 1) AS repeated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def fan_out(spark, sf):
    return quality.fan_out(table(spark, sf, "lineitem"), "l_orderkey")


@query("s1_csv_lines", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def csv_lines(spark, sf):
    """Customers written as CSV lines and read with the reader's options."""
    customers = table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    lines = customers.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))
    return parse_lines(lines, "line", customers.select(*columns).schema)
