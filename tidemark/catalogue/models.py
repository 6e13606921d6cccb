"""Feature engineering, encoding, evaluation, training, scoring, attribution and dispatch."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalogue.aggregates import LABELLED, USER_DAYS, labelled, user_days
from tidemark.catalogue.base import query, r4, rounded, sql_round as r, table
from tidemark.catalogue.joins import REGION_CURRENCY
from tidemark.catalogue.warehouse import feature_matrix, round_doubles
from tidemark.functions import half_up, lookup
from tidemark.operators import filters, mutation, profiles, quality
from tidemark.plans import attribution, dispatch, encoding, evaluation, features, scoring, training
from tidemark.plans.dispatch import audit_rows, dispatch_envelopes, dispatch_lines
from tidemark.session import cut_lineage
from tidemark.sources.schemas import AUDIT_COLUMNS, PREDICTIONS

# ---------------------------------------------------------------- features

FRICTION_SQL = """orders_view AS (
  SELECT l_orderkey AS user_account_id, sum(l_quantity) * 20 AS avg_api_wait_time_ms, max(l_quantity) * 45 AS avg_time_to_interactive_ms,
         max(l_extendedprice) / 15 AS largest_contentful_paint_ms, avg(l_quantity) * 30 AS trailing_30d_avg_latency_ms,
         count(*) FILTER (WHERE l_returnflag = 'R') AS total_failed_invoices, avg(l_discount) * 100 AS avg_rating,
         sum(l_extendedprice) AS total_revenue_contributed, count(*) FILTER (WHERE l_linestatus = 'F') AS total_ticket_escalations
  FROM lineitem GROUP BY l_orderkey)"""


def orders_view(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("user_account_id")).agg(
        (F.sum("l_quantity") * 20).alias("avg_api_wait_time_ms"), (F.max("l_quantity") * 45).alias("avg_time_to_interactive_ms"),
        (F.max("l_extendedprice") / 15).alias("largest_contentful_paint_ms"), (F.avg("l_quantity") * 30).alias("trailing_30d_avg_latency_ms"),
        F.count_if(F.col("l_returnflag") == "R").alias("total_failed_invoices"), (F.avg("l_discount") * 100).alias("avg_rating"),
        F.sum("l_extendedprice").alias("total_revenue_contributed"), F.count_if(F.col("l_linestatus") == "F").alias("total_ticket_escalations"))


# Ratings are compared after rounding, so float noise of an average cannot cross a band edge.
@query("m1_friction_features", f"""
WITH {FRICTION_SQL}, o AS (SELECT * REPLACE ({r('avg_rating', 2)} AS avg_rating, {r('total_revenue_contributed', 2)} AS total_revenue_contributed) FROM orders_view),
m AS (SELECT median(total_revenue_contributed) AS mid FROM o),
f AS (SELECT *, (avg_api_wait_time_ms >= 1700)::INTEGER AS a, (avg_time_to_interactive_ms >= 2000)::INTEGER AS b, (largest_contentful_paint_ms >= 5300)::INTEGER AS c FROM o, m)
SELECT user_account_id, a AS flag_severe_backend_latency, b AS flag_poor_time_to_interactive, c AS flag_catastrophic_lcp,
       {r('trailing_30d_avg_latency_ms / (avg_api_wait_time_ms + 1e-5)')} AS latency_degradation_ratio, a + b + c AS total_friction_breaches,
       (total_failed_invoices > 0)::INTEGER AS flag_hard_invoice_failure,
       CASE WHEN avg_rating BETWEEN 1 AND 2.5 THEN 'LOW_RATING' WHEN avg_rating > 2.5 AND avg_rating <= 4 THEN 'MED_RATING' WHEN avg_rating > 4 AND avg_rating <= 5 THEN 'HIGH_RATING' ELSE 'NO_RATING' END AS rating_bucket,
       (total_revenue_contributed > mid AND total_ticket_escalations > 0)::INTEGER AS flag_enterprise_high_touch_cushion FROM f""")
def friction(spark, sf):
    view = rounded(orders_view(spark, sf), "avg_rating", "total_revenue_contributed", places=2)
    middle = profiles.quantile_values(view, ["total_revenue_contributed"], [0.5])["total_revenue_contributed"][0]
    out = features.friction_features(view, middle)
    kept = [c for c in out.columns if c.startswith("flag_") or c in ("user_account_id", "latency_degradation_ratio", "total_friction_breaches", "rating_bucket")]
    return rounded(out.select(*kept), "latency_degradation_ratio")


MOMENTUM_SQL = f"""{USER_DAYS}, ends AS (SELECT user_id, max(activity_date) AS last_day FROM user_days GROUP BY user_id),
mom AS (SELECT d.user_id, avg(minutes) FILTER (WHERE activity_date >= last_day - 7) AS recent, avg(minutes) AS usual, count(*) AS days,
  sum(purchases) AS clicks, sum(errors) AS refreshes FROM user_days d JOIN ends e ON d.user_id = e.user_id GROUP BY d.user_id),
vec AS (SELECT user_id, refreshes, {r('CASE WHEN usual = 0 THEN 0 ELSE (recent * 4 - usual * 30) / (usual * 30) END')} AS velocity,
  {r('CASE WHEN clicks = 0 THEN 0 ELSE days * usual / clicks END')} AS density FROM mom)"""


def momentum_view(spark, sf):
    days = user_days(spark, sf)
    ends = days.groupBy("user_id").agg(F.max("activity_date").alias("last_day"))
    recent = F.col("activity_date") >= F.date_sub("last_day", 7)
    return days.join(ends, "user_id").groupBy("user_id").agg(
        F.avg(F.when(recent, F.col("minutes"))).alias("trailing_7d_avg_active_minutes"), F.avg("minutes").alias("avg_daily_active_minutes"),
        F.count(F.lit(1)).alias("total_active_days_observed"), F.sum("purchases").alias("total_clickstream_events"),
        F.sum("errors").alias("frequent_refresh_clicks"))


@query("m2_momentum_features", f"""
WITH {MOMENTUM_SQL}, p AS (SELECT quantile_cont(density, 0.1) AS low FROM vec)
SELECT user_id, velocity AS engagement_velocity_mom, density AS session_density, (density < low)::INTEGER AS is_frantic_user, (refreshes > 0)::INTEGER AS flag_rage_refresh_clicker FROM vec, p""")
def momentum(spark, sf):
    view = momentum_view(spark, sf)
    density = view.select(r4(features.session_density()).alias("session_density"))
    floor = profiles.quantile_values(density, ["session_density"], [0.1])["session_density"][0]
    out = rounded(features.momentum_features(view, floor), "engagement_velocity_mom", "session_density")
    return out.select("user_id", "engagement_velocity_mom", "session_density", (F.col("session_density") < floor).cast("int").alias("is_frantic_user"),
                      "flag_rage_refresh_clicker")


@query("m3_skew_log1p", f"""
WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total,
  count(*) FILTER (WHERE o_totalprice > 495000) AS rare FROM orders GROUP BY o_custkey)
SELECT o_custkey, {r('total')} AS total, {r('ln(1 + rare)')} AS rare_log1p FROM t""")
def skew_log(spark, sf):
    rare = F.col("o_totalprice") > 495000
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count_if(rare).alias("rare"))
    skewed = features.skewed_columns(totals, ["total", "rare", "absent"])
    return round_doubles(features.log_transform(totals, skewed))


@query("m4_frustration_index", f"""
WITH u AS (SELECT user_id, avg(value) AS waits, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS failed, (count(*) FILTER (WHERE event_type = 'purchase') > 12)::INTEGER::DOUBLE AS frantic FROM events GROUP BY user_id)
SELECT user_id, {r('0.45 * (waits - avg(waits) OVER ()) / (stddev_samp(waits) OVER () + 1e-9) + 0.35 * (failed - avg(failed) OVER ()) / (stddev_samp(failed) OVER () + 1e-9) + 0.2 * (frantic - avg(frantic) OVER ()) / (stddev_samp(frantic) OVER () + 1e-9)')} AS technical_frustration_index FROM u""")
def frustration(spark, sf):
    kind = F.col("event_type")
    users = table(spark, sf, "events").groupBy("user_id").agg(
        F.avg("value").alias("avg_api_wait_time_ms"), F.count_if(kind == "error").alias("trailing_30d_failed_logins_count"),
        (F.count_if(kind == "purchase") > 12).cast("int").alias("is_frantic_user"))
    moments = features.fit_frustration(users)
    return users.select("user_id", r4(features.frustration_index(moments)).alias("technical_frustration_index"))


# ---------------------------------------------------------------- encoding and splits


def _encoded_sql(column):
    return f"""SELECT {column} AS c, 1 / (1 + exp(-(count(*) - 20) / 10.0)) * avg(bad) + (1 - 1 / (1 + exp(-(count(*) - 20) / 10.0))) * any_value(prior) AS e
  FROM labelled, (SELECT avg(bad) AS prior FROM labelled) GROUP BY {column}"""


@query("m5_target_encoding", f"""
WITH {LABELLED}, a AS ({_encoded_sql('lang')}), b AS ({_encoded_sql('source')}), p AS (SELECT avg(bad) AS prior FROM labelled)
SELECT d.doc_id, {r('coalesce(a.e, prior)')} AS lang, {r('coalesce(b.e, prior)')} AS source
FROM documents d CROSS JOIN p LEFT JOIN a ON d.lang = a.c LEFT JOIN b ON d.source = b.c""")
def target_encoding(spark, sf):
    fitted, prior = encoding.fit_target_encoding(labelled(spark, sf), ["lang", "source"], "bad")
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return rounded(encoding.apply_target_encoding(documents, fitted, ["lang", "source"], prior), "lang", "source")


@query("m6_one_hot", """
SELECT o_orderkey, (o_orderpriority = '2-HIGH')::INTEGER::DOUBLE AS "p_2-HIGH", (o_orderpriority = '3-MEDIUM')::INTEGER::DOUBLE AS "p_3-MEDIUM",
       (o_orderpriority = '4-NOT SPECIFIED')::INTEGER::DOUBLE AS "p_4-NOT SPECIFIED", (o_orderpriority = '5-LOW')::INTEGER::DOUBLE AS "p_5-LOW" FROM orders""")
def one_hot(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"))
    return encoding.one_hot(orders, encoding.fit_levels(orders, ["p"]))


PRUNE_SQL = "SELECT *, l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 + l_tax AS doubled FROM lineitem"


@query("m7_corr_prune", f"""
WITH t AS ({PRUNE_SQL}), c AS (SELECT 'l_extendedprice' AS feature_a, 'net' AS feature_b, corr(l_extendedprice, net) AS c FROM t
  UNION ALL SELECT 'l_quantity', 'doubled', corr(l_quantity, doubled) FROM t)
SELECT feature_a, feature_b, {r('c')} AS corr FROM c WHERE abs(c) > 0.85""")
def corr_prune(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("doubled"))
    columns = items.columns
    found = encoding.correlation_matrix(items, columns)
    dropped = encoding.redundant_columns(found, columns)
    pairs = encoding.redundant_pairs(items, columns).filter(F.col("feature_b").isin(dropped))
    return rounded(pairs, "corr")


@query("m8_stratified_folds", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), f AS (SELECT unnest(range(5)) AS fold)
SELECT quality, CAST(fold AS INTEGER) AS fold, CAST(n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS rows FROM c, f""")
def stratified_folds(spark, sf):
    dealt = encoding.stratified_parts(table(spark, sf, "labels"), "quality", "doc_id", 5, name="fold")
    return dealt.groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- evaluation

SCORED = f"{LABELLED}, scored AS (SELECT 1000 / (1000 + n_chars) AS score, bad FROM labelled)"


def scored(spark, sf):
    return labelled(spark, sf).select((F.lit(1000) / (F.lit(1000) + F.col("n_chars"))).alias("score"), "bad")


CURVE = """steps AS (SELECT score, sum(bad) AS p, sum(1 - bad) AS q FROM scored GROUP BY score),
cum AS (SELECT score, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np FROM steps WINDOW w AS (ORDER BY score DESC)),
pts AS (SELECT score, tp / (tp + fp) AS prec, tp / np AS rec FROM cum),
curve AS (SELECT *, lag(prec, 1, 1.0) OVER (ORDER BY score DESC) AS prec0, lag(rec, 1, 0.0) OVER (ORDER BY score DESC) AS rec0 FROM pts)"""


@query("m12_average_precision", f"""
WITH {SCORED}, {CURVE}
SELECT {r('sum((rec - rec0) * prec)')} AS average_precision, {r('sum((rec - rec0) * (prec + prec0) / 2)')} AS pr_area, {r('arg_min(score, (abs(score - 0.35), score))')} AS near_threshold,
       {r('arg_min(prec, (abs(score - 0.35), score))')} AS near_precision, {r('arg_min(rec, (abs(score - 0.35), score))')} AS near_recall,
       {r('(SELECT avg(power(score - bad, 2)) FROM scored)')} AS brier_score FROM curve""")
def average_precision(spark, sf):
    out = evaluation.curve_summary(scored(spark, sf), "score", "bad")
    return rounded(out, *out.columns)


@query("m13_precision_recall_curve", f"""
WITH {SCORED}, {CURVE} SELECT {r('score', 8)} AS threshold, {r('prec')} AS precision, {r('rec')} AS recall FROM curve""")
def precision_recall_curve(spark, sf):
    curve = evaluation.precision_recall(scored(spark, sf), "score", "bad").select("threshold", "precision", "recall")
    return rounded(rounded(curve, "threshold", places=8), "precision", "recall")


@query("m14_calibration_bins", f"""
WITH {SCORED} SELECT CAST(greatest(ceil(score * 5) - 1, 0) AS INTEGER) AS bin, count(*) AS rows_in_bin, {r('avg(score)')} AS mean_predicted, {r('avg(bad)')} AS fraction_positive FROM scored GROUP BY ALL""")
def calibration(spark, sf):
    return rounded(evaluation.calibration_bins(scored(spark, sf), "score", "bad"), "mean_predicted", "fraction_positive")


# At the optimum of the sigmoid the residuals against the smoothed targets add up to nothing, alone and times the margin.
@query("m15_platt", f"""
WITH {SCORED} SELECT count(*) AS rows, CAST(sum(bad) AS BIGINT) AS positives, CAST(0 AS DOUBLE) AS residual, CAST(0 AS DOUBLE) AS moment FROM scored""")
def platt(spark, sf):
    rows = cut_lineage(scored(spark, sf))
    slope, offset = training.fit_sigmoid(rows, "score", "bad")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("p")).first()
    target = F.when(F.col("bad") == 1, F.lit((totals.p + 1) / (totals.p + 2))).otherwise(F.lit(1 / (totals.n - totals.p + 2)))
    gaps = rows.withColumn("gap", training.sigmoid("score", slope, offset) - target)
    return gaps.agg(F.count(F.lit(1)).alias("rows"), F.sum("bad").cast("long").alias("positives"),
                    half_up(F.abs(F.sum("gap") / F.count(F.lit(1))), 4).alias("residual"),
                    half_up(F.abs(F.sum(F.col("gap") * F.col("score")) / F.count(F.lit(1))), 4).alias("moment"))


# ---------------------------------------------------------------- training on documents and on the feature matrix


def training_rows(spark, sf):
    return cut_lineage(labelled(spark, sf).select("doc_id", "lang", "source", "n_chars", "toxic", "bad"))


# Every model scores each row of every fold once; folds are dealt class by class. The metrics of each model and fold follow
# from its scores by the plain definitions: precision summed over steps of recall, and the mean squared error.
@query("m10_train_predict", f"""
WITH {LABELLED}, sizes AS (SELECT bad, count(*) AS n FROM labelled GROUP BY bad), folds AS (SELECT unnest(range(5)) AS fold),
models AS (SELECT unnest(['elastic_net', 'boosted_trees', 'random_forest']) AS model), dealt AS (SELECT fold, bad, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS n FROM folds, sizes)
SELECT model, CAST(fold AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) FILTER (WHERE bad = 1) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS documents, TRUE AS in_range,
       TRUE AS average_precision_follows, TRUE AS brier_score_follows FROM models, dealt GROUP BY model, fold""")
def train_predict(spark, sf):
    scores: list = []
    results = training.cross_validate(training_rows(spark, sf), 5, "bad", "doc_id", engineered=False, scores=scores)
    held = scores[0]
    for more in scores[1:]:
        held = held.unionByName(more)
    steps = held.groupBy("model", "fold", "score").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("model", "fold").orderBy(F.desc("score"))
    upto = steps.withColumns({"true": F.sum("hits").over(down), "all": F.sum("n").over(down), "positives": F.sum("hits").over(Window.partitionBy("model", "fold"))})
    precision = upto.groupBy("model", "fold").agg(F.sum(F.col("hits") / F.col("positives") * F.col("true") / F.col("all")).alias("plain"), F.max("positives").cast("long").alias("positives"))
    errors = held.groupBy("model", "fold").agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("error"), F.countDistinct("doc_id").alias("documents"))
    joined = results.join(precision, ["model", "fold"]).join(errors, ["model", "fold"])
    return joined.select("model", "fold", "rows", "positives", "documents", (F.col("average_precision").between(0, 1) & F.col("brier_score").between(0, 1)).alias("in_range"),
                         (F.abs(F.col("average_precision") - F.col("plain")) < 1e-9).alias("average_precision_follows"),
                         (F.abs(F.col("brier_score") - F.col("error")) < 1e-9).alias("brier_score_follows"))


# Every user lies nearest to the centre of its own cluster, and each centre is the mean of its members.
@query("m16_personas", f"""
WITH {MOMENTUM_SQL}
SELECT user_id, CAST(3 AS INTEGER) AS clusters, {r('usual', 2)} AS minutes, CAST(clicks AS BIGINT) AS clicks, CAST(refreshes AS BIGINT) AS refreshes,
       TRUE AS nearest_centre, TRUE AS centre_is_mean FROM mom""")
def personas(spark, sf):
    columns = ["avg_daily_active_minutes", "total_clickstream_events", "frequent_refresh_clicks"]
    view = cut_lineage(momentum_view(spark, sf))
    model = training.fit_personas(view, columns)
    centres = [[float(v) for v in c] for c in model.stages[-1].clusterCenters()]
    placed = model.transform(view).withColumns({f"x{i}": vector_to_array("__scaled")[i] for i in range(len(columns))})
    far = F.array(*[sum(F.pow(F.col(f"x{i}") - F.lit(v), 2) for i, v in enumerate(c)) for c in centres])
    means = profiles.group_means(placed, "persona_cluster", [f"x{i}" for i in range(len(columns))])      # one row per cluster
    own = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("persona_cluster") + 1)
    gap = sum(F.abs(F.col(f"mean_x{i}") - own[i]) for i in range(len(columns)))
    return placed.join(means, "persona_cluster").select(
        "user_id", F.lit(len(centres)).alias("clusters"), half_up(columns[0], 2).alias("minutes"), F.col(columns[1]).alias("clicks"), F.col(columns[2]).alias("refreshes"),
        (F.element_at(far, F.col("persona_cluster") + 1) <= F.array_min(far) + 1e-9).alias("nearest_centre"), (gap < 1e-6).alias("centre_is_mean"))


# For every row the contributions and the expected margin add up to the margin, and the driver is the largest of them.
@query("m17_attribution", f"WITH {LABELLED} SELECT doc_id, TRUE AS adds_up, TRUE AS driver_is_largest, CAST(3 AS INTEGER) AS drivers FROM labelled")
def attributions(spark, sf):
    bundle = training.train_bundle(training_rows(spark, sf), "bad", "doc_id", engineered=False, winner="boosted_trees")
    explained = training.score(training_rows(spark, sf), bundle, ("doc_id",))
    names = bundle.recipe.order
    total = F.aggregate("contributions", F.lit(bundle.expected_margin), lambda a, v: a + v)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("primary_driver")).cast("int")
    return explained.select("doc_id", (F.abs(total - F.col("margin")) < 1e-6).alias("adds_up"),
                            (F.element_at("contributions", place) == F.array_max("contributions")).alias("driver_is_largest"),
                            F.size(attribution.top_drivers("contributions", names)).alias("drivers"))


PREDICTION_KEEP = ("user_account_id", "country", "industry_type", "registration_plan_code", "customer_tenure_days", "is_churned",
                   "currency", "total_revenue_contributed")


@query("m23_prediction_frame")
def prediction_frame(spark, sf):
    matrix = cut_lineage(quality.strip_token(feature_matrix(spark, sf)))
    bundle = training.train_bundle(matrix, winner="boosted_trees")
    return scoring.prediction_frame(training.score(matrix, bundle, PREDICTION_KEEP))


# ---------------------------------------------------------------- value, tiers

CURRENCY_SQL = "CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' ELSE 'CHF' END"
VALUE_SQL = f"""spent AS (SELECT o_custkey, {r('sum(o_totalprice) / 1000', 2)} AS revenue, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), DATE '2001-12-31') AS INTEGER) AS tenure,
  count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*) AS p FROM orders GROUP BY o_custkey),
v AS (SELECT c_custkey, {CURRENCY_SQL} AS currency, revenue, tenure, p FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN spent ON c_custkey = o_custkey),
w AS (SELECT *, revenue * CASE currency WHEN 'USD' THEN 84.0 WHEN 'EUR' THEN 90.0 WHEN 'JPY' THEN 0.55 WHEN 'GBP' THEN 105.0 ELSE 1.0 END AS inr, revenue / greatest(tenure, 1) * 30 AS arpu FROM v),
x AS (SELECT *, inr / greatest(tenure, 1) * 30 AS arpu_inr, arpu * 0.8 / (p + 1e-5) AS ltv FROM w),
y AS (SELECT *, arpu_inr * 0.8 / (p + 1e-5) AS ltv_inr FROM x)"""


def value_view(spark, sf):
    day = F.to_date("o_orderdate")
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        half_up(F.sum("o_totalprice") / 1000, 2).alias("revenue"), F.datediff(F.lit(dt.date(2001, 12, 31)), F.min(day)).alias("tenure"),
        (F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("p"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    customers = table(spark, sf, "customer").join(nations, "c_nationkey").select("c_custkey", lookup("n_regionkey", REGION_CURRENCY, "CHF").alias("currency"))
    return customers.join(spent, "c_custkey", "left")


@query("m19_value_matrix", f"""
WITH {VALUE_SQL}, z AS (SELECT *, CASE WHEN p >= 0.35 AND ltv_inr > 50000 THEN 'VIP_RED_ALERT' WHEN p >= 0.35 AND ltv_inr <= 50000 THEN 'AUTOMATED_LOW_COST_EMAIL' ELSE 'STABLE_NO_ACTION' END AS action FROM y)
SELECT c_custkey, currency, {r('inr')} AS normalized_revenue_inr, {r('arpu_inr')} AS monthly_arpu, {r('ltv_inr', 2)} AS calibrated_ltv, action AS action_trigger,
       CASE action WHEN 'VIP_RED_ALERT' THEN 'CRITICAL_ENTERPRISE_RISK' WHEN 'AUTOMATED_LOW_COST_EMAIL' THEN 'ELEVATED_SMB_RISK' ELSE 'STABLE_ACCOUNT' END AS risk_tier,
       CASE WHEN p >= 0.35 AND ltv > CASE currency WHEN 'USD' THEN 600 WHEN 'EUR' THEN 550 WHEN 'GBP' THEN 500 WHEN 'JPY' THEN 90000 WHEN 'INR' THEN 50000 ELSE 600 END THEN 'VIP_RED_ALERT'
            WHEN p >= 0.35 THEN 'AUTOMATED_LOW_COST_EMAIL' ELSE 'STABLE_NO_ACTION' END AS native_tier,
       CASE WHEN p < 0.3 THEN 'LOW' WHEN p < 0.7 THEN 'MEDIUM' WHEN p IS NOT NULL THEN 'HIGH' END AS risk_band FROM z""")
def value_matrix(spark, sf):
    out = scoring.value_matrix(value_view(spark, sf), "p", "revenue", "tenure", "currency")
    native = out.withColumn("ltv", scoring.lifetime_value(scoring.monthly_arpu(F.col("revenue"), "tenure"), "p"))
    chosen = native.select("c_custkey", "currency", "normalized_revenue_inr", "monthly_arpu", "calibrated_ltv", "action_trigger", "risk_tier",
                           scoring.native_currency_tier("p", "ltv", "currency").alias("native_tier"), scoring.risk_band("p").alias("risk_band"))
    return rounded(rounded(chosen, "calibrated_ltv", places=2), "normalized_revenue_inr", "monthly_arpu")


@query("a30_tier_counts", f"""
WITH {VALUE_SQL} SELECT CASE WHEN p >= 0.35 AND ltv_inr > 50000 THEN 'VIP_RED_ALERT' WHEN p >= 0.35 AND ltv_inr <= 50000 THEN 'AUTOMATED_LOW_COST_EMAIL' ELSE 'STABLE_NO_ACTION' END AS action_trigger, count(*) AS rows FROM y GROUP BY ALL""")
def tier_counts(spark, sf):
    return filters.tier_counts(scoring.value_matrix(value_view(spark, sf), "p", "revenue", "tenure", "currency"), "action_trigger")


DRIVER_SQL = "list_sort([{'v': 1e-3 * (inr - 300.0), 'i': 0, 'n': 'normalized_revenue_inr'}, {'v': -1e-2 * (tenure - 2000.0), 'i': -1, 'n': 'tenure'}, {'v': 5.0 * (p - 0.3), 'i': -2, 'n': 'p'}], 'DESC')"


@query("m24_assessment_documents", f"""
WITH {VALUE_SQL}, z AS (SELECT *, {DRIVER_SQL} AS d FROM y)
SELECT c_custkey, {r('round_even(CAST(p AS DECIMAL(18,10)), 4)')} AS probability, CASE WHEN p >= 0.35 AND ltv_inr > 50000 THEN 'VIP_RED_ALERT' WHEN p >= 0.35 AND ltv_inr <= 50000 THEN 'AUTOMATED_LOW_COST_EMAIL' ELSE 'STABLE_NO_ACTION' END AS tier,
       CASE WHEN p >= 0.35 AND ltv_inr > 50000 THEN 'CRITICAL_ENTERPRISE_RISK' WHEN p >= 0.35 AND ltv_inr <= 50000 THEN 'ELEVATED_SMB_RISK' ELSE 'STABLE_ACCOUNT' END AS risk_tier,
       {r('round_even(CAST(arpu_inr AS DECIMAL(38,10)), 2)', 0)} AS arpu, CASE WHEN tenure IS NOT NULL THEN d[1].n END AS first_driver, CASE WHEN tenure IS NOT NULL THEN d[3].n END AS first_anchor FROM z""")
def assessments(spark, sf):
    valued = scoring.value_matrix(value_view(spark, sf), "p", "revenue", "tenure", "currency")
    names = ["normalized_revenue_inr", "tenure", "p"]
    parts = attribution.linear_contributions(names, [1e-3, -1e-2, 5.0], [300.0, 2000.0, 0.3])
    document = scoring.assessment_json("p", "action_trigger", "monthly_arpu", "calibrated_ltv",
                                       attribution.top_drivers(parts, names), attribution.bottom_anchors(parts, names))
    documents = valued.select("c_custkey", "tenure", document.alias("document"))

    def read(path):
        return F.get_json_object("document", path)

    known = F.col("tenure").isNotNull()
    return documents.select(
        "c_custkey", r4(read("$.user_risk_assessment.calibrated_churn_probability").cast("double")).alias("probability"),
        read("$.user_risk_assessment.allocated_operational_tier").alias("tier"), read("$.user_risk_assessment.risk_tier").alias("risk_tier"),
        half_up(read("$.customer_financial_profile_inr.monthly_arpu_inr").cast("double"), 0).alias("arpu"),
        F.when(known, read("$.root_cause_diagnosis.top_frustration_vectors[0]")).alias("first_driver"),
        F.when(known, read("$.root_cause_diagnosis.top_retention_anchors[0]")).alias("first_anchor"))


# ---------------------------------------------------------------- prediction table maintenance

UPSERT_SQL = """base AS (SELECT CAST(c_custkey AS VARCHAR) AS user_account_id, c_mktsegment AS industry_type, c_acctbal AS projected_ltv, TIMESTAMP '2024-01-01' AS prediction_timestamp,
  'APPROVED' AS audit_action_status FROM customer WHERE c_acctbal > 1000),
batch AS (SELECT CAST(c_custkey AS VARCHAR) AS user_account_id, max(o_orderpriority) AS industry_type, max(o_totalprice) AS projected_ltv
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 5000 GROUP BY c_custkey)"""


def held_predictions(spark, sf):
    """Customers that the table holds; those left out are keys that the batch brings anew."""
    key = F.col("c_custkey").cast("string").alias("user_account_id")
    held = table(spark, sf, "customer").filter("c_acctbal > 1000").select(
        key, F.col("c_mktsegment").alias("industry_type"), F.col("c_acctbal").alias("projected_ltv"),
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("prediction_timestamp"), F.lit("APPROVED").alias("audit_action_status"))
    return mutation.add_columns(held, [*PREDICTIONS.fields, *AUDIT_COLUMNS.fields])


def prediction_batch(spark, sf):
    """A batch that overlaps the held customers: some of its keys are known, some are not."""
    best = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderpriority").alias("industry_type"), F.max("o_totalprice").alias("projected_ltv"))
    key = F.col("c_custkey").cast("string").alias("user_account_id")
    return table(spark, sf, "customer").filter("c_acctbal < 5000").join(best, "c_custkey", "left").select(key, "industry_type", "projected_ltv")


@query("s8_upsert", f"""
WITH {UPSERT_SQL}
SELECT coalesce(b.user_account_id, n.user_account_id) AS user_account_id, CASE WHEN n.user_account_id IS NULL THEN b.industry_type ELSE n.industry_type END AS industry_type,
       CASE WHEN n.user_account_id IS NULL THEN b.projected_ltv ELSE n.projected_ltv END AS projected_ltv,
       coalesce(prediction_timestamp, TIMESTAMP '2024-02-01') AS prediction_timestamp, audit_action_status
FROM base b FULL JOIN batch n ON b.user_account_id = n.user_account_id""")
def upsert(spark, sf):
    loaded_at = F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")
    merged = mutation.upsert(held_predictions(spark, sf), prediction_batch(spark, sf), "user_account_id", ["industry_type", "projected_ltv"], loaded_at, "prediction_timestamp")
    return merged.select("user_account_id", "industry_type", "projected_ltv", "prediction_timestamp", "audit_action_status")


@query("s9_keyed_update", """
WITH u AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS note FROM orders GROUP BY o_custkey)
SELECT c_custkey AS user_account_id, c_mktsegment, CASE WHEN o_custkey IS NULL THEN 'PENDING_REVIEW' WHEN status = 'F' THEN 'BLOCKED' ELSE 'APPROVED' END AS audit_action_status,
       CASE WHEN o_custkey IS NULL THEN '' ELSE note END AS audit_notes, CASE WHEN o_custkey IS NULL THEN '' ELSE 'operations_manager' END AS audit_override_by,
       CASE WHEN o_custkey IS NOT NULL THEN TIMESTAMP '2024-02-01 08:00:00' END AS audit_override_at FROM customer LEFT JOIN u ON c_custkey = o_custkey""")
def keyed_update(spark, sf):
    base = filters.with_audit_columns(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_account_id"), "c_mktsegment"))
    edits = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_account_id"), F.col("o_orderkey").alias("edit_no"),
        F.when(F.col("o_orderstatus") == "F", "BLOCKED").otherwise("APPROVED").alias("audit_action_status"),
        F.col("o_orderpriority").alias("audit_notes"), F.lit("").alias("audit_override_by"), F.lit(None).cast("timestamp_ntz").alias("audit_override_at"))
    stamped = filters.stamp_edits(edits, "operations_manager", dt.datetime(2024, 2, 1, 8))
    columns = [f.name for f in AUDIT_COLUMNS.fields]
    return mutation.keyed_update(base, stamped, "user_account_id", columns, "edit_no")


@query("s9_update_counts", """
SELECT count(*) AS submitted, count(c_custkey) AS matched FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def update_counts(spark, sf):
    base = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return mutation.update_counts(base, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("f17_bulk_decision", """
SELECT c_custkey, 'DO_NOT_CONTACT' AS audit_action_status, 'bulk' AS audit_notes, 'operations_manager' AS audit_override_by, TIMESTAMP '2024-02-01' AS audit_override_at FROM customer WHERE c_mktsegment = 'BUILDING'""")
def bulk_decision(spark, sf):
    chosen = filters.in_tier(table(spark, sf, "customer"), "BUILDING", "c_mktsegment").select("c_custkey")
    return filters.bulk_decision(filters.with_audit_columns(chosen), "DO_NOT_CONTACT", "bulk", "operations_manager", dt.datetime(2024, 2, 1))


# ---------------------------------------------------------------- dispatch

RUN, USER, AT = "run-2024-02-01", "operations_manager", dt.datetime(2024, 2, 1, 9, 30)
APPROVED_SQL = """approved AS (SELECT CAST(c_custkey AS VARCHAR) AS user_account_id,
  CASE WHEN c_acctbal > 5000 THEN 'VIP_RED_DISPATCH' ELSE 'AUTOMATED_EMAIL_DISPATCH' END AS event_type,
  CASE WHEN c_acctbal > 5000 THEN 'VIP_RED_ALERT' ELSE 'AUTOMATED_LOW_COST_EMAIL' END AS tier,
  CASE WHEN c_acctbal > 5000 THEN 'SLACK_DISPATCH_TO_SALES' ELSE 'AI_EMAIL_AUTOMATION_TRIGGERED' END AS action_taken,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS audit_notes FROM customer WHERE c_acctbal > 1000 AND c_nationkey < 15)"""


def reviewed(spark, sf):
    tier = F.when(F.col("c_acctbal") > 5000, scoring.VIP).when(F.col("c_acctbal") > 1000, scoring.EMAIL).otherwise(scoring.STABLE)
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("user_account_id"), tier.alias("allocated_operational_tier"), F.col("c_acctbal").alias("projected_ltv"),
        F.when(F.col("c_nationkey") < 15, "approved").otherwise("BLOCKED").alias("audit_action_status"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("audit_notes"))


@query("m25_dispatch_outbox", f"""
WITH {APPROVED_SQL}
SELECT event_type, count(*) AS customers, substr(sha256('{RUN}|' || event_type), 1, 32) AS request_id, '{USER}' AS triggered_by, '2024-02-01T09:30:00' AS sent_at,
       'CS,SALES' AS target_teams, 'Please call.' AS notes FROM approved GROUP BY event_type""")
def dispatch_outbox(spark, sf):
    """The envelopes read back from their documents."""
    shape = "event_type string, request_id string, triggered_by string, timestamp string, target_teams array<string>, notes string, customers long"
    parsed = dispatch_envelopes(reviewed(spark, sf), RUN, USER, AT, "Please call.").select(F.from_json("payload", shape).alias("d")).select("d.*")
    return parsed.select("event_type", "customers", "request_id", "triggered_by", F.col("timestamp").alias("sent_at"),
                         F.array_join("target_teams", ",").alias("target_teams"), "notes")


@query("m25_dispatch_payloads", f"""
WITH {APPROVED_SQL}
SELECT event_type, substr(sha256('{RUN}|' || event_type), 1, 32) AS request_id, user_account_id, tier, audit_notes, action_taken, 'PENDING' AS status, '2024-02-01 09:30:00' AS logged_at FROM approved""")
def dispatch_documents(spark, sf):
    """Customers and log stubs read back from their lines."""
    shape = ("event_type string, request_id string, customer struct<user_account_id: string, allocated_operational_tier: string, audit_notes: string>, "
             "log struct<user_account_id: string, action_taken: string, timestamp: string, status: string>")
    parsed = dispatch_lines(reviewed(spark, sf), RUN, AT).select(F.from_json("payload", shape).alias("d")).select("d.*")
    return parsed.filter("customer.user_account_id = log.user_account_id").select(
        "event_type", "request_id", "customer.user_account_id", F.col("customer.allocated_operational_tier").alias("tier"),
        "customer.audit_notes", "log.action_taken", "log.status", F.col("log.timestamp").alias("logged_at"))


@query("m26_audit_rows", f"""
WITH {APPROVED_SQL}
SELECT substr(sha256('{RUN}|' || event_type || '|' || user_account_id), 1, 32) AS audit_id, user_account_id, tier AS allocated_operational_tier, 'approved' AS action_status, action_taken,
       audit_notes AS action_notes, '{USER}' AS triggered_by, substr(sha256('{RUN}|' || event_type), 1, 32) AS request_id, 'outbox' AS automation_target,
       '{{"ok": true}}' AS automation_response, 'SUCCESS' AS status, TIMESTAMP '{AT}' AS event_timestamp FROM approved""")
def audit_log_rows(spark, sf):
    return audit_rows(reviewed(spark, sf), RUN, USER, AT, "outbox", '{"ok": true}')


@query("m27_message_texts", f"""
WITH {APPROVED_SQL}
SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY user_account_id) - 1 AS position, user_account_id AS id, coalesce(audit_notes, '') AS note,
       CASE event_type WHEN 'VIP_RED_DISPATCH' THEN 'VIP Customers at Churn Risk' ELSE 'Send automated emails to these customers' END AS subject,
       CASE event_type WHEN 'VIP_RED_DISPATCH' THEN 'Here is the list of customer_id: ' || chr(10) || '{{ids}}' || chr(10) || chr(10) || 'Here are the audit notes:' || chr(10) || '{{notes}}'
            ELSE 'Send Automated emails to:' || chr(10) || '{{ids}}' || chr(10) END AS template FROM approved""")
def messages(spark, sf):
    return dispatch.message_lines(reviewed(spark, sf))
