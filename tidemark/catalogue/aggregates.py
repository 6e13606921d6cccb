"""Aggregations and exploratory profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.base import query, r4, rounded, sql_round as r, table
from tidemark.functions import count_where, distinct_list, flag, guarded_ratio, half_up, seconds_between, sum_where
from tidemark.operators import profiles, quality, survival
from tidemark.operators.neighbours import NEIGHBOURS, neighbour_information
from tidemark.operators.ranking import exact_quantiles
from tidemark.plans.dispatch import joined_lines

LABELLED = """labelled AS (
  SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars, l.quality, l.toxic,
         1 - l.quality AS bad, length(d.lang) + l.toxic AS trouble
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    joined = documents.join(table(spark, sf, "labels"), "doc_id")
    return joined.withColumns({"bad": 1 - F.col("quality"), "trouble": F.length("lang") + F.col("toxic")})


@query("a1_event_counts_per_user", """
SELECT user_id, CAST(ts AS DATE) AS activity_date, count(event_id) AS events,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases,
       count(DISTINCT event_type) AS kinds
FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def event_counts(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("activity_date")).agg(
        F.count("event_id").alias("events"), count_where(kind == "error").alias("errors"),
        count_where(kind == "purchase").alias("purchases"), F.countDistinct("event_type").alias("kinds"))


@query("a4_rounded_means", f"""
SELECT user_id, {r('avg(value)', 0)} AS mean_0, {r('avg(value)', 2)} AS mean_2, {r('avg(value)', 3)} AS mean_3
FROM events GROUP BY user_id""")
def rounded_means(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(
        *[half_up(F.avg("value"), places).alias(f"mean_{places}") for places in (0, 2, 3)])


@query("a5_conditional_sums", f"""
SELECT l_orderkey, {r('sum(CASE WHEN l_returnflag <> $$R$$ THEN l_extendedprice ELSE 0 END)'.replace('$$', chr(39)), 2)} AS collected,
       CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS has_failure,
       {r('sum(l_extendedprice)', 2)} AS billed, {r('max(o_totalprice)', 2)} AS order_value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def conditional_sums(spark, sf):
    flagged = F.col("l_returnflag")
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        half_up(sum_where(flagged != "R", "l_extendedprice"), 2).alias("collected"),
        F.max(flag(flagged == "R")).alias("has_failure"), half_up(F.sum("l_extendedprice"), 2).alias("billed"))
    values = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), half_up("o_totalprice", 2).alias("order_value"))
    return per_order.join(values, "l_orderkey")


@query("a8_variant_columns", """
SELECT user_id, max(props) FILTER (WHERE event_type = 'view') AS view_props,
       max(props) FILTER (WHERE event_type = 'click') AS click_props, max(event_type) AS last_kind
FROM events GROUP BY user_id""")
def variant_columns(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(
        *[F.max(F.when(F.col("event_type") == kind, F.col("props"))).alias(f"{kind}_props") for kind in ("view", "click")],
        F.max("event_type").alias("last_kind"))


@query("a9_distinct_lists", """
WITH brands AS (
  SELECT l_orderkey, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands,
         string_agg(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linestatus END, ', '
                    ORDER BY CASE WHEN l_returnflag = 'R' THEN l_linestatus END) AS returned_states
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT * FROM brands""")
def distinct_lists(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_linestatus"))
    return items.join(parts, "l_partkey").groupBy("l_orderkey").agg(
        distinct_list("p_brand").alias("brands"), distinct_list(returned).alias("returned_states"))


@query("a10_gap_duration", f"""
WITH days AS (SELECT user_id, CAST(ts AS DATE) AS d, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT user_id, {r('avg(epoch_us(b) - epoch_us(a)) / 1e6', 2)} AS avg_seconds, {r('sum((epoch_us(b) - epoch_us(a)) / 1e6)', 3)} AS total_seconds
FROM days GROUP BY user_id""")
def gap_duration(spark, sf):
    days = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = seconds_between("a", "b")
    return days.groupBy("user_id").agg(half_up(F.avg(seconds), 2).alias("avg_seconds"), half_up(F.sum(seconds), 3).alias("total_seconds"))


USER_DAYS = """user_days AS (
  SELECT user_id, CAST(ts AS DATE) AS activity_date, count(*) AS actions, sum(value) AS minutes,
         CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors,
         CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""
ANCHORS = """anchors AS (
  SELECT user_id, min(activity_date) AS first_day, max(activity_date) AS last_day, CAST(max(CASE WHEN errors > 3 THEN 1 ELSE 0 END) AS INTEGER) AS troubled
  FROM user_days GROUP BY user_id)"""
TRAILING = """recent AS (
  SELECT d.user_id,
         avg(CASE WHEN d.activity_date >= a.last_day - 7 THEN d.minutes END) AS minutes_7d,
         CAST(sum(CASE WHEN d.activity_date >= a.last_day - 7 THEN d.purchases ELSE 0 END) AS BIGINT) AS purchases_7d,
         CAST(sum(CASE WHEN d.activity_date >= a.last_day - 7 THEN d.actions ELSE 0 END) AS BIGINT) AS actions_7d,
         CAST(sum(CASE WHEN d.activity_date >= a.last_day - 30 THEN d.errors ELSE 0 END) AS BIGINT) AS errors_30d,
         count(DISTINCT d.activity_date) AS active_days, CAST(sum(d.purchases) AS BIGINT) AS purchases,
         CAST(sum(d.errors) AS BIGINT) AS errors,
         CAST(sum(d.actions) AS BIGINT) AS actions, avg(d.minutes) AS avg_minutes, max(d.minutes) AS max_minutes
  FROM user_days d JOIN anchors a ON d.user_id = a.user_id GROUP BY d.user_id)"""


def user_days(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("activity_date")).agg(
        F.count(F.lit(1)).alias("actions"), F.sum("value").alias("minutes"), count_where(kind == "error").alias("errors"),
        count_where(kind == "purchase").alias("purchases"))


def day_anchors(days):
    return days.groupBy("user_id").agg(F.min("activity_date").alias("first_day"), F.max("activity_date").alias("last_day"),
                                       F.max(flag(F.col("errors") > 3)).alias("troubled"))


def trailing(days):
    dated = days.join(day_anchors(days).select("user_id", "last_day"), "user_id")

    def within(count):
        return F.col("activity_date") >= F.date_sub("last_day", count)

    return dated.groupBy("user_id").agg(
        F.avg(F.when(within(7), F.col("minutes"))).alias("minutes_7d"), sum_where(within(7), "purchases").alias("purchases_7d"),
        sum_where(within(7), "actions").alias("actions_7d"), sum_where(within(30), "errors").alias("errors_30d"),
        F.countDistinct("activity_date").alias("active_days"), F.sum("purchases").alias("purchases"), F.sum("errors").alias("errors"),
        F.sum("actions").alias("actions"), F.avg("minutes").alias("avg_minutes"), F.max("minutes").alias("max_minutes"))


@query("a12_anchors", f"""
WITH {USER_DAYS}, {ANCHORS}
SELECT user_id, first_day, last_day, troubled, CAST(last_day - first_day AS INTEGER) AS tenure_days FROM anchors""")
def anchors(spark, sf):
    return day_anchors(user_days(spark, sf)).withColumn("tenure_days", F.datediff("last_day", "first_day"))


@query("a13_trailing_features", f"""
WITH {USER_DAYS}, {ANCHORS}, {TRAILING}
SELECT user_id, {r('minutes_7d')} AS minutes_7d, purchases_7d, actions_7d, errors_30d FROM recent""")
def trailing_features(spark, sf):
    return rounded(trailing(user_days(spark, sf)).select("user_id", "minutes_7d", "purchases_7d", "actions_7d", "errors_30d"), "minutes_7d")


@query("a14_lifetime_features", f"""
WITH {USER_DAYS}, {ANCHORS}, {TRAILING}
SELECT user_id, active_days, purchases, errors, actions, {r('avg_minutes')} AS avg_minutes, {r('max_minutes')} AS max_minutes FROM recent""")
def lifetime_features(spark, sf):
    out = trailing(user_days(spark, sf)).select("user_id", "active_days", "purchases", "errors", "actions", "avg_minutes", "max_minutes")
    return rounded(out, "avg_minutes", "max_minutes")


DROP_RATIOS = f"""
       {r('CASE WHEN coalesce(avg_minutes, 0) = 0 THEN 0.0 ELSE coalesce(minutes_7d, 0) / avg_minutes END')} AS minutes_drop_ratio,
       {r('CASE WHEN purchases = 0 THEN 0.0 ELSE (purchases_7d / 7.0) / (CAST(purchases AS DOUBLE) / active_days) END')} AS purchase_drop_ratio"""


def drop_ratios(df):
    return df.withColumns({
        "minutes_drop_ratio": r4(guarded_ratio(F.coalesce("minutes_7d", F.lit(0.0)), "avg_minutes")),
        "purchase_drop_ratio": r4(guarded_ratio(F.col("purchases_7d") / 7.0, guarded_ratio("purchases", "active_days")))})


@query("a16_drop_ratio", f"WITH {USER_DAYS}, {ANCHORS}, {TRAILING} SELECT user_id, {DROP_RATIOS} FROM recent")
def drop_ratio(spark, sf):
    return drop_ratios(trailing(user_days(spark, sf))).select("user_id", "minutes_drop_ratio", "purchase_drop_ratio")


@query("a18_percentiles_by_class", f"""
SELECT o_orderstatus, {r('quantile_cont(o_totalprice, 0.5)')} AS p50, {r('quantile_cont(o_totalprice, 0.95)')} AS p95,
       {r('quantile_cont(o_totalprice, 0.99)')} AS p99, {r('quantile_cont(o_totalprice, 0.999)')} AS p999
FROM orders GROUP BY o_orderstatus""")
def percentiles_by_class(spark, sf):
    found = exact_quantiles(table(spark, sf, "orders"), ["o_totalprice"], [0.5, 0.95, 0.99, 0.999], ["o_orderstatus"])
    return found.select("o_orderstatus", *[r4(f"q{i}").alias(n) for i, n in enumerate(("p50", "p95", "p99", "p999"))])


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a19_correlation_long", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})')} AS corr FROM lineitem"
    for i, a in enumerate(MEASURES) for b in MEASURES[i:]))
def correlation_long(spark, sf):
    return rounded(profiles.correlations(table(spark, sf, "lineitem"), MEASURES), "corr")


def _variation_sql(c):
    m3 = f"avg(power({c} - m, 3))"
    return (f"SELECT '{c}' AS column_name, {r('any_value(m)')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'{m3} / power(stddev_pop({c}), 3)')} AS skew, "
            f"{r(f'CASE WHEN any_value(m) = 0 THEN 0 ELSE stddev_samp({c}) / any_value(m) END')} AS coef_variation "
            f"FROM orders, (SELECT avg({c}) AS m FROM orders)")


@query("a20_coef_variation", _variation_sql("o_totalprice"))
def coef_variation(spark, sf):
    return rounded(profiles.variation(table(spark, sf, "orders"), ["o_totalprice"]), "mean", "std", "skew", "coef_variation")


@query("a21_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, CAST(min({c}) AS DOUBLE) AS min_value,
       CAST(max({c}) AS DOUBLE) AS max_value, {r(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)')} AS null_pct,
       {r(f'count(*) FILTER (WHERE {c} = 0) * 100.0 / count(*)')} AS zero_pct, {r(f'median({c})')} AS median FROM lineitem""" for c in MEASURES))
def profile(spark, sf):
    out = profiles.univariate(table(spark, sf, "lineitem"), MEASURES)
    return rounded(out, "mean", "std", "null_pct", "zero_pct", "median")


@query("p6_describe", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS filled, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, CAST(min({c}) AS DOUBLE) AS min_value,
       CAST(max({c}) AS DOUBLE) AS max_value, {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50,
       {r(f'quantile_cont({c}, 0.75)')} AS p75 FROM lineitem""" for c in MEASURES))
def describe(spark, sf):
    return rounded(quality.describe(table(spark, sf, "lineitem"), MEASURES), "mean", "std", "p25", "p50", "p75")


@query("a22_median_shift", f"""
WITH {LABELLED}, m AS (SELECT median(n_chars) FILTER (WHERE bad = 0) AS a, median(n_chars) FILTER (WHERE bad = 1) AS b FROM labelled)
SELECT 'n_chars' AS feature, {r('a')} AS median_negative, {r('b')} AS median_positive, {r('(b - a) / (a + 1e-5) * 100')} AS shift_pct FROM m""")
def median_shift(spark, sf):
    return rounded(profiles.median_shift(labelled(spark, sf), ["n_chars"], "bad"), "median_negative", "median_positive", "shift_pct")


def bins_sql(source: str, column: str, bins: int, key: str) -> str:
    """CTEs ``edges`` (distinct quantile edges) and ``placed`` (rows with a right-closed bin)."""
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""edges AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i FROM (
    SELECT DISTINCT unnest(quantile_cont({column}, [{probs}])) AS e FROM {source})),
  placed AS (SELECT s.*, CAST(greatest((SELECT count(*) FROM edges WHERE e < s.{column}) - 1, 0) AS INTEGER) AS bin
    FROM {source} s WHERE {column} IS NOT NULL)"""


@query("a23_quantile_bin_rate", f"""
WITH {LABELLED}, {bins_sql('labelled', 'n_chars', 5, 'doc_id')}
SELECT bin, count(*) AS rows_in_bin, {r('avg(bad)')} AS label_rate, min(n_chars) AS lowest, max(n_chars) AS highest FROM placed GROUP BY bin""")
def quantile_bin_rate(spark, sf):
    return rounded(profiles.rate_by_bin(labelled(spark, sf), "n_chars", "bad", 5), "label_rate")


@query("a24_decile_median", f"""
WITH edges AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM lineitem),
placed AS (SELECT l_quantity, CAST(greatest(len(list_filter(e, lambda x: x < l_extendedprice)) - 1, 0) AS INTEGER) AS bin FROM lineitem, edges)
SELECT bin, {r('median(l_quantity)')} AS median_value FROM placed GROUP BY bin""")
def decile_median(spark, sf):
    return rounded(profiles.median_by_bin(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 10), "median_value")


def _zero_active_sql(c):
    active = f"coalesce(avg(bad) FILTER (WHERE {c} > 0), 0)"
    idle = f"coalesce(avg(bad) FILTER (WHERE NOT coalesce({c} > 0, false)), 0)"
    return (f"SELECT '{c}' AS column_name, {r(active)} AS active_rate, {r(idle)} AS zero_rate, {r('avg(bad)')} AS base_rate, "
            f"{r(f'{active} * 100 / ({idle} * 100 + 1e-5)')} AS lift FROM labelled")


@query("a25_zero_vs_active", f"WITH {LABELLED} " + " UNION ALL ".join(_zero_active_sql(c) for c in ("toxic", "n_chars")))
def zero_vs_active(spark, sf):
    return rounded(profiles.zero_against_active(labelled(spark, sf), ["toxic", "n_chars"], "bad"), "active_rate", "zero_rate", "base_rate", "lift")


@query("a26_class_balance", f"""WITH {LABELLED} SELECT count(*) AS rows, {r('avg(bad)')} AS positive_rate,
{r('count(*) FILTER (WHERE bad = 0) / CAST(count(*) FILTER (WHERE bad = 1) AS DOUBLE)')} AS imbalance FROM labelled""")
def class_balance(spark, sf):
    return rounded(profiles.class_balance(labelled(spark, sf), "bad"), "positive_rate", "imbalance")


def _cells(value, age, status):
    return {f"{age}_{k}": v for k, v in (("median", f"median({value}) FILTER (WHERE age = '{age}')"), ("rate", f"avg({status}) FILTER (WHERE age = '{age}')"))}


@query("a27_pivot_median_mean", f"""
WITH base AS (SELECT CASE WHEN c_acctbal <= 200 THEN 'Fast (<200ms)' WHEN c_acctbal <= 1500 THEN 'Degraded (200ms-1.5s)' WHEN c_acctbal > 1500 THEN 'Catastrophic (>1.5s)' ELSE 'Degraded' END AS latency_tier,
  CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'Mature Users' ELSE 'New Users' END AS age, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS failed
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT latency_tier, {', '.join(f'{r(e)} AS "{n}"' for age in ('New Users', 'Mature Users') for n, e in _cells('o_totalprice', age, 'failed').items())}
FROM base GROUP BY latency_tier""")
def pivot_median_mean(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    orders = table(spark, sf, "orders").join(customers, "o_custkey").select(
        profiles.latency_tier("c_acctbal").alias("latency_tier"),
        F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "Mature Users").otherwise("New Users").alias("age"),
        "o_totalprice", flag(F.col("o_orderstatus") == "F").alias("failed"))
    out = profiles.pivot_median_and_rate(orders, "latency_tier", "age", ["New Users", "Mature Users"], "o_totalprice", "failed")
    return rounded(out, *[c for c in out.columns if c != "latency_tier"])


@query("a28_pivot_mean_count", f"""
WITH {LABELLED}, m AS (SELECT median(n_chars) AS mid FROM labelled),
base AS (SELECT CASE WHEN toxic > 0 THEN 'Has Escalations' ELSE 'Clean/No Escalations' END AS support_friction, n_chars > mid AS high, bad FROM labelled, m)
SELECT support_friction, {r('avg(bad) FILTER (WHERE NOT high)')} AS "Standard_rate", count(bad) FILTER (WHERE NOT high) AS "Standard_rows",
       {r('avg(bad) FILTER (WHERE high)')} AS "High_rate", count(bad) FILTER (WHERE high) AS "High_rows" FROM base GROUP BY support_friction""")
def pivot_mean_count(spark, sf):
    base = labelled(spark, sf)
    middle = profiles.quantile_values(base, ["n_chars"], [0.5])["n_chars"][0]
    tagged = base.withColumns({
        "support_friction": F.when(F.col("toxic") > 0, "Has Escalations").otherwise("Clean/No Escalations"),
        "revenue_tier": F.when(F.col("n_chars") > middle, "High").otherwise("Standard")})
    out = profiles.pivot_rate_and_count(tagged, "support_friction", "revenue_tier", ["Standard", "High"], "bad")
    out = rounded(out, "Standard_rate", "High_rate")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("Standard_rows", "High_rows")})


@query("a31_catch_rate", f"""
WITH {LABELLED}, s AS (SELECT bad, n_chars < 500 AS hit FROM labelled),
c AS (SELECT count(*) FILTER (WHERE bad = 1 AND hit) AS true_positives, count(*) FILTER (WHERE bad = 0 AND hit) AS false_positives,
             count(*) FILTER (WHERE bad = 1 AND NOT hit) AS false_negatives FROM s)
SELECT *, {r('true_positives / (true_positives + false_negatives + 1e-5)')} AS catch_rate FROM c""")
def catch_rate(spark, sf):
    return rounded(profiles.catch_rate(labelled(spark, sf), F.col("n_chars") < 500, "bad"), "catch_rate")


@query("a32_kaplan_meier", f"""
WITH spans AS (
  SELECT o_custkey, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS t,
         CASE WHEN arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'F' THEN 1 ELSE 0 END AS died FROM orders GROUP BY o_custkey),
tab AS (SELECT c_mktsegment AS cohort, CAST(t AS INTEGER) AS t, count(*) AS leaving, count(*) FILTER (WHERE died = 1) AS deaths
        FROM spans JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
risk AS (SELECT *, CAST(sum(leaving) OVER (PARTITION BY cohort ORDER BY t DESC) AS BIGINT) AS at_risk FROM tab),
curve AS (SELECT cohort, t, deaths, at_risk,
  CASE WHEN max(CASE WHEN deaths = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0
       ELSE exp(sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths / at_risk::DOUBLE) ELSE 0 END) OVER w) END AS s,
  sum(CASE WHEN deaths < at_risk THEN deaths / (at_risk::DOUBLE * (at_risk - deaths)) ELSE 0 END) OVER w AS g
  FROM risk WINDOW w AS (PARTITION BY cohort ORDER BY t))
SELECT cohort, t, deaths, at_risk, {r('s')} AS survival,
  {r('CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) - 1.959963984540054 * sqrt(g) / ln(s))) ELSE s END')} AS lower,
  {r('CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) + 1.959963984540054 * sqrt(g) / ln(s))) ELSE s END')} AS upper FROM curve""")
def kaplan_meier(spark, sf):
    day = F.to_date("o_orderdate")
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.datediff(F.max(day), F.min(day)).alias("t"),
        flag(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")) == "F").alias("died"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    curve = survival.kaplan_meier(spans.join(customers, "o_custkey"), "c_mktsegment", "t", "died")
    return rounded(curve, "survival", "lower", "upper")


@query("a33_binned_mi_top", f"""
WITH {LABELLED}, f AS (SELECT 'n_chars' AS feature, n_chars AS v, bad AS y FROM labelled UNION ALL SELECT 'toxic', toxic, bad FROM labelled
  UNION ALL SELECT 'trouble', trouble, bad FROM labelled),
q AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{', '.join(str(i / 20) for i in range(21))}]))) AS e FROM f GROUP BY feature),
cell AS (SELECT f.feature, greatest(len(list_filter(e, lambda x: x < v)) - 1, 0) AS b, y, count(*)::DOUBLE AS n FROM f JOIN q ON f.feature = q.feature GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nn FROM cell)
SELECT feature, {r('sum(n / nn * ln(n * nn / (nb * ny)))')} AS information FROM m GROUP BY feature ORDER BY information DESC, feature LIMIT 5""")
def binned_mi_top(spark, sf):
    found = profiles.binned_information(labelled(spark, sf), ["n_chars", "toxic", "trouble"], "bad", 20)
    return rounded(profiles.strongest(found), "information")


def information_sql(source: str, features: list[str], label: str, k: int = NEIGHBOURS) -> str:
    """A plain SQL twin that compares all pairs of rows; CTE ``information`` holds feature and information."""
    psi = lambda x: (f"(ln({x} + 6.0) - 0.5 / ({x} + 6.0) - (1 / 12.0 - (1 / 120.0 - (1 / 252.0 - 1 / (240.0 * power({x} + 6.0, 2))) / power({x} + 6.0, 2)) / power({x} + 6.0, 2)) / power({x} + 6.0, 2)"
                     + "".join(f" - 1.0 / ({x} + {i})" for i in range(6)) + ")")
    wide = " UNION ALL ".join(f"SELECT '{f}' AS feature, row_number() OVER () AS id, {label} AS y, CAST({f} AS DOUBLE) AS v FROM {source} WHERE {label} IS NOT NULL" for f in features)
    return f"""
kept AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS nx FROM ({wide}) QUALIFY nx > 1),
near AS (SELECT a.feature, a.id, any_value(a.v) AS v, any_value(a.nx) AS nx, list_sort(list(abs(a.v - b.v)))[CAST(least({k}, any_value(a.nx) - 1) AS BIGINT)] AS r
  FROM kept a JOIN kept b ON a.feature = b.feature AND a.y = b.y AND a.id <> b.id GROUP BY a.feature, a.id),
inner_rows AS (SELECT n.feature, n.id, any_value(n.nx) AS nx, count(*) AS m
  FROM near n JOIN kept b ON n.feature = b.feature AND (CASE WHEN r = 0 THEN b.v = n.v ELSE b.v > n.v - r AND b.v < n.v + r END) GROUP BY n.feature, n.id),
information AS (SELECT feature, greatest(0.0, {psi('count(*)')} + avg({psi(f'least({k}, nx - 1)')}) - avg({psi('nx')}) - avg({psi('m')})) AS information FROM inner_rows GROUP BY feature)"""


@query("a33_neighbour_information", f"""
WITH {LABELLED}, {information_sql('labelled', ['n_chars', 'toxic', 'trouble'], 'bad')}
SELECT feature, {r('information', 6)} AS information FROM information""")
def neighbour_mutual_information(spark, sf):
    return rounded(neighbour_information(labelled(spark, sf), ["n_chars", "toxic", "trouble"], "bad"), "information", places=6)


@query("a35_joined_ids", """
SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS position, CAST(c_custkey AS VARCHAR) AS id,
       CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '' END AS note FROM customer""")
def joined_ids(spark, sf):
    noted = table(spark, sf, "customer").withColumn("note", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return joined_lines(noted, "c_mktsegment", "c_custkey", "note")
