"""Joins, intervals, windows and per-row arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.aggregates import ANCHORS, DROP_RATIOS, TRAILING, USER_DAYS, day_anchors, drop_ratios, trailing, user_days
from tidemark.catalogue.base import ORDERS_AS_OF, query, r4, rounded, sql_round as r, table
from tidemark.functions import count_where, distinct_list, fill_defaults, flag, half_up, lookup, sum_where
from tidemark.operators.intervals import facts_by_state, interval_day_counts, interval_days, state_intervals
from tidemark.operators.joins import full_outer_daily, left_join_many, rate_lookup, scalar_lookup
from tidemark.plans.attribution import bottom_anchors, primary_driver, top_drivers
from tidemark.plans.scoring import INR_RATES

# Currency per region in this test mapping; the fifth region has none.
REGION_CURRENCY = {0: "USD", 1: "EUR", 2: "GBP", 3: "JPY"}


@query("j1_star_left_join", f"""
WITH o AS (SELECT o_custkey, count(*) AS orders, {r('sum(o_totalprice)', 2)} AS spent FROM orders GROUP BY o_custkey),
e AS (SELECT user_id, count(*) AS events, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY user_id),
l AS (SELECT o_custkey, count(*) AS lines, {r('avg(l_quantity)', 2)} AS avg_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
t AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)
SELECT c_custkey, n_name AS country, orders, spent, events, errors, lines, avg_quantity, coalesce(turns, 0) AS turns
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN e ON c_custkey = user_id
LEFT JOIN l ON c_custkey = l.o_custkey LEFT JOIN t ON c_custkey = conv_id""")
def star_left_join(spark, sf):
    orders = table(spark, sf, "orders")
    keys = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    rollups = [
        orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), half_up(F.sum("o_totalprice"), 2).alias("spent")),
        table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
            F.count(F.lit(1)).alias("events"), count_where(F.col("event_type") == "error").alias("errors")),
        per_order.join(keys, "l_orderkey").groupBy("c_custkey").agg(F.sum("n").alias("lines"), half_up(F.sum("q") / F.sum("n"), 2).alias("avg_quantity")),
        table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("turns")),
    ]
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    wide = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey").drop("c_nationkey")
    for rollup in rollups:
        wide = wide.join(rollup, "c_custkey", "left")
    return fill_defaults(wide, {"turns": 0})


@query("j1_left_join_many", """
SELECT c_custkey, c_mktsegment, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def many_orders(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return left_join_many(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), orders, ["c_custkey"])


@query("j2_fanout_inner", f"""
WITH roll AS (SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey)
SELECT o_custkey, CAST(o_orderdate AS DATE) AS activity_date, count(*) AS pairs, {r('sum(o_totalprice)', 2)} AS repeated_value,
       CAST(sum(roll.lines) AS BIGINT) AS repeated_lines, {r('max(l_extendedprice)', 2)} AS largest
FROM orders JOIN lineitem ON o_orderkey = lineitem.l_orderkey JOIN roll ON o_orderkey = roll.l_orderkey GROUP BY o_custkey, CAST(o_orderdate AS DATE)""")
def fanout_inner(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag")
    rolled = items.filter("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_totalprice")
    return orders.join(rolled, "l_orderkey").join(items.drop("l_returnflag"), "l_orderkey").groupBy(
        "o_custkey", F.to_date("o_orderdate").alias("activity_date")).agg(
        F.count(F.lit(1)).alias("pairs"), half_up(F.sum("o_totalprice"), 2).alias("repeated_value"),
        F.sum("lines").alias("repeated_lines"), half_up(F.max("l_extendedprice"), 2).alias("largest"))


@query("j3_bridge_daily", f"""
SELECT o_custkey, CAST(l_shipdate AS DATE) AS activity_date, {r("sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END)", 2)} AS paid,
       CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS has_failure, string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) AS methods
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, CAST(l_shipdate AS DATE)""")
def bridge_daily(spark, sf):
    flagged = F.col("l_returnflag")
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey", F.to_date("l_shipdate").alias("activity_date"), "l_linestatus").agg(
        sum_where(flagged != "R", "l_extendedprice").alias("paid"), F.max(flag(flagged == "R")).alias("failed"))
    bridge = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return per_order.join(bridge, "l_orderkey").groupBy("o_custkey", "activity_date").agg(
        half_up(F.sum("paid"), 2).alias("paid"), F.max("failed").alias("has_failure"), distinct_list("l_linestatus").alias("methods"))


INTERVALS = f"""iv AS (
  SELECT o_custkey, o_orderstatus AS state, CAST(o_orderdate AS DATE) AS valid_from,
         coalesce(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1, DATE '{ORDERS_AS_OF}') AS valid_to FROM orders)"""


def order_intervals(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("state"))
    return state_intervals(orders, "o_custkey", "o_orderdate", "o_orderkey", "state", ORDERS_AS_OF)


@query("j5_state_interval_days", f"""
WITH {INTERVALS}, d AS (SELECT o_custkey, state, unnest(generate_series(valid_from, valid_to, INTERVAL 1 DAY)) AS day FROM iv WHERE valid_from <= valid_to)
SELECT o_custkey, state, count(*) AS days, CAST(min(day) AS DATE) AS first_day, CAST(max(day) AS DATE) AS last_day FROM d GROUP BY o_custkey, state""")
def state_interval_days(spark, sf):
    days = interval_days(order_intervals(spark, sf), ORDERS_AS_OF)
    return days.groupBy("o_custkey", "state").agg(
        F.count(F.lit(1)).alias("days"), F.min("activity_date").alias("first_day"), F.max("activity_date").alias("last_day"))


@query("j5_interval_lengths", f"""
WITH {INTERVALS} SELECT o_custkey, state, CAST(sum(valid_to - valid_from + 1) AS BIGINT) AS days FROM iv WHERE valid_from <= valid_to GROUP BY o_custkey, state""")
def interval_lengths(spark, sf):
    return interval_day_counts(order_intervals(spark, sf), ["o_custkey", "state"], ORDERS_AS_OF)


@query("w1_lead_intervals", f"WITH {INTERVALS} SELECT * FROM iv WHERE valid_from <= valid_to")
def lead_intervals(spark, sf):
    return order_intervals(spark, sf).filter("valid_from <= valid_to")


@query("j6_full_outer_daily", f"""
WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, o_custkey AS k, count(*) AS orders FROM orders GROUP BY ALL),
b AS (SELECT CAST(l_shipdate AS DATE) AS d, o_custkey AS k, count(*) AS shipped, {r('sum(l_extendedprice)', 2)} AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS o_custkey, coalesce(a.d, b.d) AS activity_date, coalesce(orders, 0) AS orders, coalesce(shipped, 0) AS shipped, coalesce(value, 0.0) AS value
FROM a FULL JOIN b ON a.k = b.k AND a.d = b.d""")
def outer_daily(spark, sf):
    orders = table(spark, sf, "orders")
    placed = orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("activity_date")).agg(F.count(F.lit(1)).alias("orders"))
    per_order = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("activity_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("v"))
    shipped = per_order.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey", "activity_date").agg(
        F.sum("n").alias("shipped"), half_up(F.sum("v"), 2).alias("value"))
    return full_outer_daily(placed, shipped, ["o_custkey", "activity_date"], {"orders": 0, "shipped": 0, "value": 0.0})


@query("j7_full_outer_three", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n, max(props) AS p FROM events GROUP BY ALL),
v AS (SELECT * FROM d WHERE event_type = 'view'), c AS (SELECT * FROM d WHERE event_type = 'click'), e AS (SELECT * FROM d WHERE event_type = 'error')
SELECT coalesce(v.user_id, c.user_id, e.user_id) AS user_id, coalesce(v.day, c.day, e.day) AS activity_date,
       coalesce(v.n, 0) AS views, coalesce(c.n, 0) AS clicks, coalesce(e.n, 0) AS errors, coalesce(v.p, c.p, e.p) AS props
FROM v FULL JOIN c ON v.user_id = c.user_id AND v.day = c.day FULL JOIN e ON coalesce(v.user_id, c.user_id) = e.user_id AND coalesce(v.day, c.day) = e.day""")
def outer_three(spark, sf):
    keys = ["user_id", "activity_date"]
    sides = [table(spark, sf, "events").filter(F.col("event_type") == kind).groupBy("user_id", F.to_date("ts").alias("activity_date")).agg(
        F.count(F.lit(1)).alias(name), F.max("props").alias(f"p_{name}")) for kind, name in (("view", "views"), ("click", "clicks"), ("error", "errors"))]
    joined = full_outer_daily(full_outer_daily(sides[0], sides[1], keys), sides[2], keys, {"views": 0, "clicks": 0, "errors": 0})
    return joined.withColumn("props", F.coalesce("p_views", "p_clicks", "p_errors")).drop("p_views", "p_clicks", "p_errors")


@query("j8_snapshot", f"""
WITH {INTERVALS}, spine AS (SELECT o_custkey AS k, state, CAST(unnest(generate_series(valid_from, valid_to, INTERVAL 1 DAY)) AS DATE) AS d FROM iv WHERE valid_from <= valid_to),
a AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, count(*) AS orders, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
b AS (SELECT o_custkey AS k, CAST(l_shipdate AS DATE) AS d, count(*) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
snap AS (SELECT spine.k, spine.d, state, coalesce(orders, 0) AS orders, coalesce(value, 0) AS value, coalesce(shipped, 0) AS shipped
  FROM spine LEFT JOIN a ON spine.k = a.k AND spine.d = a.d LEFT JOIN b ON spine.k = b.k AND spine.d = b.d)
SELECT k AS o_custkey, state, count(*) AS days, CAST(sum(orders) AS BIGINT) AS orders, {r('sum(value)', 2)} AS value, CAST(sum(shipped) AS BIGINT) AS shipped,
       {r('avg(shipped)')} AS shipped_per_day FROM snap GROUP BY k, state""")
def snapshot(spark, sf):
    keys = ["o_custkey", "activity_date"]
    orders = table(spark, sf, "orders")
    intervals = order_intervals(spark, sf)
    placed = orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("activity_date")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("value"))
    per_order = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("activity_date")).agg(F.count(F.lit(1)).alias("n"))
    shipped = per_order.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy(keys).agg(F.sum("n").alias("shipped"))
    facts = placed.unionByName(shipped, allowMissingColumns=True)
    in_state = facts_by_state(intervals, facts, "o_custkey", "activity_date", "state", ORDERS_AS_OF).groupBy("o_custkey", "state").agg(
        F.sum("orders").alias("orders"), F.sum("value").alias("value"), F.sum("shipped").alias("shipped"))
    days = interval_day_counts(intervals, ["o_custkey", "state"], ORDERS_AS_OF)
    joined = fill_defaults(days.join(in_state, ["o_custkey", "state"], "left"), {"orders": 0, "value": 0.0, "shipped": 0})
    return joined.select("o_custkey", "state", "days", "orders", half_up("value", 2).alias("value"), "shipped",
                         r4(F.col("shipped") / F.col("days")).alias("shipped_per_day"))


@query("j10_matrix", f"""
WITH {USER_DAYS}, {ANCHORS}, {TRAILING}
SELECT c_custkey AS user_id, n_name AS country, r_name AS region, c_mktsegment AS segment, CAST(last_day - first_day AS INTEGER) AS tenure_days,
       active_days, actions, purchases, errors, purchases_7d, actions_7d, errors_30d, {r('avg_minutes')} AS avg_minutes,
       {r('minutes_7d')} AS minutes_7d, {DROP_RATIOS}, troubled AS is_churned
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN anchors ON c_custkey = anchors.user_id JOIN recent ON c_custkey = recent.user_id""")
def matrix(spark, sf):
    days = user_days(spark, sf)
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    users = table(spark, sf, "customer").join(places, "c_nationkey").select(
        F.col("c_custkey").alias("user_id"), "country", "region", F.col("c_mktsegment").alias("segment"))
    anchored = day_anchors(days).select("user_id", F.datediff("last_day", "first_day").alias("tenure_days"), F.col("troubled").alias("is_churned"))
    joined = drop_ratios(users.join(anchored, "user_id").join(trailing(days), "user_id"))
    return rounded(joined.drop("max_minutes"), "avg_minutes", "minutes_7d")


@query("j11_scalar_lookup", """
SELECT l_orderkey, l_partkey, (SELECT p_name FROM part WHERE p_partkey = l_partkey) AS part_name,
       (SELECT p_brand FROM part WHERE p_partkey = l_partkey) AS brand FROM lineitem""")
def lookup_part(spark, sf):
    return scalar_lookup(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf, "part"), "l_partkey", "p_partkey",
                         {"part_name": "p_name", "brand": "p_brand"})


@query("j13_rate_lookup", f"""
WITH c AS (SELECT c_custkey, c_acctbal, CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' ELSE 'CHF' END AS currency
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, currency, {r("c_acctbal * CASE currency WHEN 'INR' THEN 1.0 WHEN 'USD' THEN 84.0 WHEN 'EUR' THEN 90.0 WHEN 'JPY' THEN 0.55 WHEN 'GBP' THEN 105.0 ELSE 1.0 END", 2)} AS value_inr,
       coalesce(s.rate, -1.0) AS supplier_rate
FROM c LEFT JOIN (SELECT s_suppkey, max(s_acctbal) AS rate FROM supplier GROUP BY s_suppkey) s ON c_custkey = s_suppkey""")
def rates(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    valued = table(spark, sf, "customer").join(nations, "c_nationkey").select(
        "c_custkey", lookup("n_regionkey", REGION_CURRENCY, "CHF").alias("currency"), "c_acctbal")
    converted = valued.select("c_custkey", "currency", half_up(F.col("c_acctbal") * lookup("currency", INR_RATES, 1.0), 2).alias("value_inr"))
    return rate_lookup(converted, table(spark, sf, "supplier"), "c_custkey", "s_suppkey", "s_acctbal", "supplier_rate", -1.0)


@query("o5_argmax_topk_array", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [{'v': l_quantity, 'i': 0, 'n': 'quantity'}, {'v': l_discount * 400, 'i': -1, 'n': 'discount'}, {'v': l_tax * 500, 'i': -2, 'n': 'tax'}] AS a FROM lineitem),
s AS (SELECT *, list_sort(a, 'DESC') AS d, list_sort(a, 'ASC') AS u FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, d[1].n AS driver, d[1].n || ',' || d[2].n AS top_2, u[1].n || ',' || u[2].n AS bottom_2 FROM s""")
def argmax_topk(spark, sf):
    names = ["quantity", "discount", "tax"]
    values = F.array(F.col("l_quantity"), F.col("l_discount") * 400, F.col("l_tax") * 500)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", primary_driver(values, names).alias("driver"),
        F.array_join(top_drivers(values, names, 2), ",").alias("top_2"), F.array_join(bottom_anchors(values, names, 2), ",").alias("bottom_2"))
