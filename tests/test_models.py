"""Encoders, measures, calibration, attribution and scoring on a seeded separable fixture."""

import datetime as dt
import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans import attribution, dispatch, encoding, evaluation, features, report, scoring, training
from tidemark.plans.warehouse import MATRIX_COLUMNS


@pytest.fixture(scope="module")
def frame():
    random = np.random.default_rng(3)
    n = 600
    data = {c.replace("lifetime_", ""): random.integers(0, 6, n).astype(float) for c in MATRIX_COLUMNS}
    for name, kinds in (("country", ["NO", "SE", "DK"]), ("industry_type", ["A", "B"]), ("network_carrier", ["x", "y"]), ("currency", ["USD", "INR"]),
                        ("registration_source", ["WEB", "IOS"]), ("registration_plan_code", ["P", "Q"]), ("registration_billing_cycle", ["MONTHLY", "YEARLY"]),
                        ("pdf_generation_variant", ["on", "off"]), ("advance_search_elastic_variant", ["on", "off"]), ("employee_count_range", ["1-10", "<5"]), ("annual_revenue_range", ["1M", "<1M"])):
        data[name] = random.choice(kinds, n)
    data["user_account_id"] = np.arange(n)
    data["avg_api_wait_time_ms"] = random.uniform(0, 3000, n)
    data["total_failed_invoices"] = random.integers(0, 2, n).astype(float)
    data["customer_tenure_days"] = random.integers(0, 400, n)
    data["is_churned"] = ((data["avg_api_wait_time_ms"] > 2300) | ((data["total_failed_invoices"] > 0) & (random.random(n) < 0.2))).astype(int)
    return pd.DataFrame(data)


@pytest.fixture(scope="module")
def matrix(spark, frame):
    return spark.createDataFrame(frame).cache()


@pytest.fixture(scope="module")
def bundle(matrix):
    return training.train_bundle(matrix, blueprints=training.model_blueprints(max_iter=4, depth=3))


KEEP = ("user_account_id", "country", "industry_type", "registration_plan_code", "customer_tenure_days", "is_churned", "currency", "total_revenue_contributed")


@pytest.fixture(scope="module")
def scored(matrix, bundle):
    return training.score(matrix, bundle, KEEP).cache()


def test_scores_rank_well_and_calibration_helps(matrix, bundle, scored):
    held = training.with_slices(matrix).filter("slice = 'evaluate'").select("user_account_id")
    rows = scored.join(held, "user_account_id").withColumn("raw", 1 / (1 + F.exp(-2 * F.col("margin"))))
    calibrated = evaluation.curve_summary(rows, "probability", "is_churned").first()
    raw = evaluation.curve_summary(rows, "raw", "is_churned").first()
    assert calibrated["average_precision"] > 0.7 and calibrated["average_precision"] == pytest.approx(raw["average_precision"])
    assert calibrated["brier_score"] <= raw["brier_score"]


def test_one_row_scores_like_the_whole_table(matrix, bundle, scored):
    one = training.score(matrix.filter("user_account_id = 7"), bundle, ("user_account_id",)).first()
    same = scored.filter("user_account_id = 7").first()
    assert one["probability"] == pytest.approx(same["probability"], abs=1e-12) and one["primary_driver"] == same["primary_driver"]


def test_saved_bundle_scores_the_same(spark, tmp_path, matrix, bundle, scored):
    bundle.save(str(tmp_path / "bundle"))
    loaded = training.Bundle.load(spark, str(tmp_path / "bundle"))
    again = training.score(matrix, loaded, ("user_account_id",), explain=False)
    assert again.join(scored.select("user_account_id", F.col("probability").alias("p")), "user_account_id").filter(F.abs(F.col("probability") - F.col("p")) > 1e-12).count() == 0


def test_contributions_add_up_to_the_margin(bundle, scored):
    leaves = bundle.leaves
    base = attribution.expected_margin(leaves)
    gap = F.abs(F.aggregate("contributions", F.lit(base), lambda a, v: a + v) - F.col("margin"))
    assert scored.filter(gap > 1e-9).count() == 0


@pytest.mark.parametrize("kind", ["elastic_net", "random_forest"])
def test_contributions_add_up_for_other_winners(matrix, kind):
    bundle = training.train_bundle(matrix, winner=kind, blueprints=training.model_blueprints(max_iter=4, depth=3))
    rows = training.score(matrix, bundle, ("user_account_id",))
    gap = F.abs(F.aggregate("contributions", F.lit(bundle.expected_margin), lambda a, v: a + v) - F.col("margin"))
    assert rows.filter(gap > 1e-9).count() == 0 and rows.filter("primary_driver IS NULL").count() == 0


def test_winner_comes_from_the_training_slice(matrix):
    chosen = training.model_blueprints(max_iter=2, depth=2)
    bundle = training.train_bundle(matrix, blueprints={k: chosen[k] for k in ("elastic_net", "boosted_trees")}, folds=2)
    assert bundle.winner in ("elastic_net", "boosted_trees")


def test_scores_without_value_have_no_place_in_the_curve(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (None, 0), (float("nan"), 1), (0.1, 0)], "s double, y int")
    clean = rows.filter("s IS NOT NULL AND NOT isnan(s)")
    assert evaluation.curve_summary(rows, "s", "y").first()["average_precision"] == pytest.approx(5 / 6)
    assert evaluation.curve_summary(rows, "s", "y").first() == evaluation.curve_summary(clean, "s", "y").first()
    assert tuple(evaluation.unscored(rows, "s").first()) == (6, 2)


def test_large_encodings_are_not_broadcast(spark):
    df = spark.createDataFrame([(f"c{i % 50}", i % 2) for i in range(200)], "c string, y int")
    table, prior = encoding.fit_target_encoding(df, ["c"], "y")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans, found = [], []
    try:
        for limit in ("10MB", "10b"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            out = encoding.apply_target_encoding(df, table, ["c"], prior)
            plans.append("Broadcast" in out._jdf.queryExecution().executedPlan().toString())
            found.append(sorted(r["c"] for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans == [True, False] and found[0] == found[1]


def test_encoding_without_text_columns(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "a int, y int")
    table, prior = encoding.fit_target_encoding(df, [], "y")
    assert table.count() == 0 and prior == 0.5 and encoding.apply_target_encoding(df, table, [], prior).count() == 2
    assert encoding.fit_levels(df, []) == {}


def test_contributions_equal_brute_force_shapley(spark, bundle, matrix):
    leaves, order = bundle.leaves, bundle.recipe.order
    ready = bundle.pipeline.transform(training.apply_recipe(matrix.limit(3), bundle.recipe, bundle.encodings, ("user_account_id",)))
    rows = attribution.add_contributions(ready, leaves, training.VECTOR, len(order)).collect()

    def value(x, known):
        total = 0.0
        for leaf in leaves:
            weight = leaf["value"]
            for f, (low, high, share) in leaf["path"].items():
                weight *= float(low < x[f] <= high) if f in known else share
            total += weight
        return total

    used = sorted({f for leaf in leaves for f in leaf["path"]})
    assert 1 < len(used) < 14
    for row in rows:
        x = row[training.VECTOR].toArray()
        for f in used[:4]:
            others = [u for u in used if u != f]
            phi = sum(math.factorial(len(s)) * math.factorial(len(others) - len(s)) / math.factorial(len(used)) * (value(x, {*s, f}) - value(x, set(s)))
                      for k in range(len(others) + 1) for s in itertools.combinations(others, k))
            assert row["contributions"][f] == pytest.approx(phi, abs=1e-9)


def test_ties_take_the_first_feature(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -1.0],)], "c array<double>")
    names = ["a", "b", "c", "d"]
    row = df.select(attribution.primary_driver("c", names).alias("p"), attribution.top_drivers("c", names).alias("t"), attribution.bottom_anchors("c", names, 2).alias("b")).first()
    assert (row["p"], row["t"], row["b"]) == ("b", ["b", "c", "a"], ["d", "a"])


def test_measures_with_tied_scores(spark):
    scores, labels = [0.9, 0.9, 0.6, 0.35, 0.35, 0.2, 0.2, 0.1, 0.05, 0.0], [1, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    df = spark.createDataFrame(list(zip(scores, labels)), "s double, y int")
    points = []
    for cut in sorted(set(scores), reverse=True):
        hit = [y for s, y in zip(scores, labels) if s >= cut]
        points.append((sum(hit) / len(hit), sum(hit) / sum(labels)))
    steps = list(zip([(1.0, 0.0), *points[:-1]], points))
    row = evaluation.curve_summary(df, "s", "y").first()
    assert row["average_precision"] == pytest.approx(sum((r - r0) * p for (_, r0), (p, r) in steps))
    assert row["pr_area"] == pytest.approx(sum((r - r0) * (p + p0) / 2 for (p0, r0), (p, r) in steps))
    assert row["brier_score"] == pytest.approx(sum((s - y) ** 2 for s, y in zip(scores, labels)) / 10)
    assert row["near_threshold"] == 0.35
    bins = {r["bin"]: r["rows_in_bin"] for r in evaluation.calibration_bins(df, "s", "y").collect()}
    assert bins == {0: 5, 1: 2, 2: 1, 4: 2}


def test_sigmoid_fit_equals_newton_iteration(spark):
    random = np.random.default_rng(5)
    x = random.normal(size=300)
    y = (random.random(300) < 1 / (1 + np.exp(-(1.7 * x - 0.4)))).astype(int)
    slope, offset = training.fit_sigmoid(spark.createDataFrame(pd.DataFrame({"m": x, "y": y})), "m", "y")
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    design, beta = np.column_stack([x, np.ones(300)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (target - p))
    assert (slope, offset) == pytest.approx(tuple(beta), abs=1e-4)


def test_target_encoding_leans_to_the_mean_and_handles_unseen(spark):
    df = spark.createDataFrame([("a", 1)] * 30 + [("b", 0)] * 2 + [(None, 0)], "c string, y int")
    table, prior = encoding.fit_target_encoding(df, ["c"], "y")
    fresh = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    got = [r["c"] for r in encoding.apply_target_encoding(fresh.withColumn("o", F.monotonically_increasing_id()), table, ["c"], prior).orderBy("o").collect()]
    weight = [1 / (1 + math.exp(-(n - 20) / 10)) for n in (30, 2)]
    assert got == pytest.approx([weight[0] + (1 - weight[0]) * prior, (1 - weight[1]) * prior, prior, prior])


def test_folds_keep_exact_strata(matrix):
    dealt = encoding.stratified_parts(matrix, "is_churned", "user_account_id", 5).groupBy("is_churned", "part").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in dealt if r["is_churned"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_redundant_columns_follow_column_order():
    pairs = {("a", "b"): 0.9, ("b", "c"): -0.95, ("a", "c"): 0.1}
    assert encoding.redundant_columns({**pairs, **{(b, a): v for (a, b), v in pairs.items()}}, ["a", "b", "c"]) == ["b", "c"]


def test_correlations_with_gaps_equal_brute_force(spark):
    random = np.random.default_rng(11)
    frame = pd.DataFrame(random.normal(size=(200, 4)), columns=list("abcd"))
    frame["d"] += frame["a"]
    frame.loc[random.random(200) < 0.3, "b"] = None
    frame.loc[random.random(200) < 0.3, "d"] = None
    df = spark.createDataFrame(frame).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame])
    found, expected = encoding.correlation_matrix(df, list("abcd")), frame.corr()
    assert all(found[a, b] == pytest.approx(expected.loc[a, b]) for a in "abcd" for b in "abcd" if a != b)


def test_levels_are_frozen_and_names_clean(bundle):
    assert any("lt_" in name for name in bundle.recipe.order) or "annual_revenue_range_lt_1M" in bundle.recipe.redundant
    assert "avg_rating" not in bundle.recipe.order and "technical_frustration_index" in [*bundle.recipe.order, *bundle.recipe.redundant]


def test_frustration_uses_the_column_before_its_log(bundle):
    assert set(bundle.recipe.frustration) == set(features.FRUSTRATION_WEIGHTS)


def test_rating_buckets(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.5,), (4.0,), (5.0,), (8.0,), (0.5,)], "r double")
    assert [r[0] for r in df.select(features.rating_bucket("r")).collect()] == ["NO_RATING", "LOW_RATING", "LOW_RATING", "MED_RATING", "HIGH_RATING", "NO_RATING", "NO_RATING"]


def test_tier_boundaries_and_missing_value(spark):
    df = spark.createDataFrame([(0.35, 600.0, "USD"), (0.35, 600.01, "USD"), (0.3499, 1e9, "USD"), (0.9, 601.0, "CHF"), (0.9, None, "USD"), (0.9, 60000.0, "JPY")], "p double, v double, c string")
    native = [r[0] for r in df.select(scoring.native_currency_tier("p", "v", "c")).collect()]
    assert native == [scoring.EMAIL, scoring.VIP, scoring.STABLE, scoring.VIP, scoring.EMAIL, scoring.EMAIL]
    common = [r[0] for r in df.select(scoring.common_currency_tier("p", "v")).collect()]
    assert common == [scoring.EMAIL, scoring.EMAIL, scoring.STABLE, scoring.EMAIL, scoring.STABLE, scoring.VIP]


def test_prediction_frame(scored):
    rows = scoring.prediction_frame(scored)
    assert rows.columns == ["user_account_id", "country", "industry_type", "registration_plan_code", "customer_tenure_days", "is_churned_historical",
                            "calibrated_churn_probability", "monthly_arpu", "projected_ltv", "currency", "allocated_operational_tier", "primary_frustration_driver_vector"]
    assert rows.count() == 600 and rows.filter("primary_frustration_driver_vector IS NULL OR calibrated_churn_probability NOT BETWEEN 0 AND 1").count() == 0


def test_scoring_plan_shuffles_nothing(matrix, bundle):
    plan = training.score(matrix, bundle, KEEP)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BatchEvalPython" not in plan


def test_cross_validation_picks_a_winner(matrix):
    chosen = training.model_blueprints(max_iter=3, depth=2)
    results = training.cross_validate(matrix, 2, blueprints={k: chosen[k] for k in ("elastic_net", "boosted_trees")})
    rows = results.collect()
    assert len(rows) == 4 and all(0 <= r["average_precision"] <= 1 for r in rows)
    assert training.pick_winner(results) in ("elastic_net", "boosted_trees")


def test_personas_cover_all_rows(matrix):
    counts = training.personas(matrix).groupBy("persona_cluster").count().collect()
    assert len(counts) == 3 and sum(r["count"] for r in counts) == 600


AT = dt.datetime(2024, 2, 1, 9)


@pytest.fixture
def reviewed(spark):
    rows = [("1", scoring.VIP, "approved", None, float("nan")), ("2", scoring.VIP, "BLOCKED", "n", 1.0), ("3", scoring.EMAIL, "APPROVED", "call", 2.0), ("4", scoring.STABLE, "APPROVED", "", 3.0)]
    return spark.createDataFrame(rows, "user_account_id string, allocated_operational_tier string, audit_action_status string, audit_notes string, projected_ltv double")


def test_payloads_hold_approved_rows_only(reviewed):
    documents = [json.loads(r["payload"]) for r in dispatch.dispatch_payloads(reviewed, "r1", "me", AT, "note").collect()]
    envelopes = {d["event_type"]: d for d in documents if d["kind"] == "envelope"}
    lines = {d["event_type"]: d for d in documents if d["kind"] == "customer"}
    assert set(envelopes) == set(lines) == {"VIP_RED_DISPATCH", "AUTOMATED_EMAIL_DISPATCH"} and len(documents) == 4
    vip = lines["VIP_RED_DISPATCH"]
    assert vip["customer"]["user_account_id"] == "1" and vip["customer"]["projected_ltv"] is None
    assert vip["log"] == {"user_account_id": "1", "action_taken": "SLACK_DISPATCH_TO_SALES", "timestamp": "2024-02-01 09:00:00", "status": "PENDING"}
    assert envelopes["VIP_RED_DISPATCH"]["target_teams"] == ["CS", "SALES"] and envelopes["VIP_RED_DISPATCH"]["customers"] == 1
    assert vip["request_id"] == envelopes["VIP_RED_DISPATCH"]["request_id"]
    assert dispatch.dispatch_payloads(reviewed.filter("audit_action_status = 'BLOCKED'"), "r1", "me", AT, "").count() == 0


def test_large_tiers_keep_their_shape(spark):
    many = spark.range(1000).select(F.col("id").cast("string").alias("user_account_id"), F.lit(scoring.VIP).alias("allocated_operational_tier"),
                                    F.lit("APPROVED").alias("audit_action_status"), F.lit(None).cast("string").alias("audit_notes"))
    assert dispatch.dispatch_payloads(many, "r1", "me", AT, "").count() == 1001
    lines = dispatch.message_lines(many).orderBy("position").collect()
    assert [r["id"] for r in lines] == sorted(str(i) for i in range(1000)) and [r["position"] for r in lines] == list(range(1000))


def test_audit_rows_are_repeatable_and_prefer_the_batch_note(reviewed):
    rows = lambda notes: sorted(tuple(r) for r in dispatch.audit_rows(reviewed, "r1", "me", AT, "outbox", "{}", notes).select("audit_id", "user_account_id", "action_notes", "action_status").collect())
    assert rows("batch") == rows("batch") and {r[2] for r in rows("batch")} == {"batch"}
    assert sorted(r[1:] for r in rows("")) == [("1", None, "approved"), ("3", "call", "APPROVED")]


def test_records_unwrap(spark):
    df = spark.createDataFrame([('{"predictions": [{"a": 1}, {"a": 2}]}',)], "body string")
    schema = spark.range(1).selectExpr("1 AS a").schema
    assert [r["a"] for r in dispatch.unwrap_records(df, "body", schema).collect()] == [1, 2]
    many = spark.range(100).select(F.col("id").cast("int").alias("a"))
    wrapped = dispatch.wrap_records(many, "predictions")
    assert wrapped.count() == 100
    assert sorted(r["a"] for r in dispatch.unwrap_records(wrapped, "body", schema).collect()) == list(range(100))


def test_report_covers_every_profile(matrix):
    tables = report.full_report(matrix)
    assert len(tables) == 20
    for name in ("median_shift", "strongest_features", "rate_by_active_minutes_drop_ratio_7d", "survival_by_total_failed_invoices", "support_gridlock"):
        assert tables[name].count() > 0
    assert tables["strongest_features"].first()["feature"] == "avg_api_wait_time_ms"


def test_text_measures_are_read_as_numbers(spark):
    df = spark.createDataFrame([("7", "NO", "1.5", "x")], "user_account_id string, country string, avg_rating string, total_reports_run string")
    assert tuple(features.typed_matrix(df).first()) == ("7", "NO", 1.5, None)
