"""Daily facts and the feature matrix on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.plans import warehouse as wh
from tidemark.sources.schemas import RAW_SCHEMAS

D, T = dt.date, dt.datetime
AS_OF = D(2024, 2, 9)


def raw_table(spark, name, *rows):
    schema = RAW_SCHEMAS[name]
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields) for row in rows], schema)


@pytest.fixture(scope="module")
def raw(spark):
    rows = {name: [] for name in RAW_SCHEMAS}
    for user in range(1, 6):
        rows["app_user_accounts"].append({"user_account_id": user, "created_at": T(2024, 1, 1), "is_deleted": user == 1, "marketing_opt_in_flag": None if user == 2 else True})
        if user != 3:
            rows["app_user_profiles"].append({"user_account_id": user, "profile_attributes_json": "{theme: dark, onboarding_completed: true}"})
    for sub, user in ((10, 1), (20, 2), (21, 2), (30, 3), (50, 5)):
        rows["subscription_accounts"].append({"subscription_id": sub, "user_account_id": user, "subscription_plan_code": "PRO", "billing_cycle": "MONTHLY", "auto_renew_enabled": True})
    states = [(10, "ACTIVE", T(2024, 1, 1)), (10, "CANCELLED", T(2024, 2, 5)), (20, "ACTIVE", T(2024, 1, 1)), (21, "ACTIVE", T(2024, 2, 1)), (30, "ACTIVE", T(2024, 3, 1))]
    for i, (sub, state, at) in enumerate(states):
        rows["subscription_state_history"].append({"subscription_state_id": i, "subscription_id": sub, "new_state": state, "effective_at": at})
    # Logins exactly 7, 8, 30 and 31 days before the last day of user 1.
    for i, day in enumerate((D(2024, 2, 2), D(2024, 2, 1), D(2024, 1, 10), D(2024, 1, 9))):
        rows["auth_login_events"].append({"login_event_id": i, "user_account_id": 1, "authentication_result": "SUCCESS" if i < 2 else "FAILURE",
                                          "user_agent_string": "Macintosh" if i == 0 else "Android", "device_fingerprint_hash": "d1", "created_at": dt.datetime.combine(day, dt.time(9))})
    rows["user_device_profiles"].append({"user_account_id": 1, "device_id": "d1", "device_model": "Pixel", "browser_name": "Chrome"})
    rows["product_sessions"] = [
        {"product_session_id": "s1", "user_account_id": 1, "device_model": "M1", "session_started_at": T(2024, 2, 1, 9), "session_ended_at": T(2024, 2, 1, 9, 10), "created_at": T(2024, 2, 1, 9)},
        {"product_session_id": "s2", "user_account_id": 1, "device_model": "M2", "session_started_at": T(2024, 2, 1, 10), "session_ended_at": None, "created_at": T(2024, 2, 1, 10)}]
    rows["frontend_performance_events"] = [{"product_session_id": "s1", "api_wait_time_ms": 100}, {"product_session_id": "s1", "api_wait_time_ms": 201}, {"product_session_id": "s2", "api_wait_time_ms": 400}]
    rows["clickstream_events"] = [{"event_id": 1, "product_session_id": "s1", "event_name": "run_report", "page_screen_name": "HOME", "latency_ms": 10, "geo_city": "Oslo"}]
    rows["support_tickets"] = [{"ticket_id": 1, "user_account_id": 1, "ticket_status": "OPEN", "ticket_priority": "HIGH", "created_at": T(2024, 2, 3)}]
    rows["support_ticket_events"] = [{"ticket_event_id": 1, "ticket_id": 1, "event_type": "ESCALATION", "created_at": T(2024, 2, 4)}, {"ticket_event_id": 2, "ticket_id": 99, "event_type": "ESCALATION", "created_at": T(2024, 2, 4)}]
    rows["billing_invoices"] = [{"invoice_id": 1, "subscription_id": 10, "invoice_status": "FAILED", "currency_code": "USD", "total_amount": 10.0, "tax_amount": 1.0, "created_at": T(2024, 1, 5)}]
    rows["payment_transactions"] = [{"invoice_id": 1, "payment_method_type": m, "transaction_status": s, "failure_code": None, "amount": 10.0, "initiated_at": T(2024, 1, 6)} for m, s in (("PAYPAL", "FAILED"), ("CARD", "SUCCESS"))]
    return {name: raw_table(spark, name, *content) for name, content in rows.items()}


@pytest.fixture(scope="module")
def built(raw):
    return {name: df.cache() for name, df in wh.build_all(raw, AS_OF).items()}


def test_profile_fans_out_per_subscription_and_keeps_null_logins(built):
    rows = built["user_profiles"].orderBy("user_account_id", "subscription_id").collect()
    assert [r["user_account_id"] for r in rows] == [1, 2, 2, 3, 4, 5] and len(built["user_profiles"].columns) == 55
    first, lonely = rows[0], rows[4]
    assert (first["total_logins"], first["total_tickets"], first["profile_theme"], first["account_deletion_flag"]) == (4, 1, "dark", 1)
    assert (lonely["subscription_status"], lonely["total_logins"], lonely["total_tickets"], lonely["subscription_id"]) == ("UNSUBSCRIBED", None, 0, None)
    assert rows[1]["marketing_opt_in_flag"] == 0


def test_dimension_defaults(built):
    row = built["dim_users"].filter("user_account_id = 4").first()
    assert (row["subscription_id"], row["auto_renew_flag"]) == (0, -1) and len(built["dim_users"].columns) == 41


def test_activity_repeats_sessions_per_performance_row_and_falls_back_to_logins(built):
    rows = {r["activity_date"]: r for r in built["user_activity_daily"].collect()}
    busy = rows[D(2024, 2, 1)]
    assert (busy["total_duration_sec"], busy["total_events"], busy["run_report_clicks"], busy["avg_api_wait_time_ms"]) == (1200.0, 2, 2, 151.0)
    assert (busy["device_models"], busy["geo_city"], busy["total_login_attempts"]) == ("M1", "Oslo", 1)
    assert (rows[D(2024, 1, 10)]["device_models"], rows[D(2024, 1, 10)]["platform_types"], rows[D(2024, 1, 10)]["browsers_used"]) == ("Pixel", "Android", "Chrome")
    assert (rows[D(2024, 2, 2)]["device_models"], rows[D(2024, 2, 2)]["platform_types"]) == (None, "UNKNOWN_PLATFORM")
    assert len(built["user_activity_daily"].columns) == 34


def test_support_and_billing_keep_days_that_only_one_side_has(built):
    support = {r["activity_date"]: (r["tickets_opened_today"], r["ticket_escalations_today"]) for r in built["customer_support_daily"].collect()}
    assert support == {D(2024, 2, 3): (1, 0), D(2024, 2, 4): (0, 1)}
    billing = {r["activity_date"]: r for r in built["billing_and_revenue_daily"].collect()}
    paid = billing[D(2024, 1, 6)]
    assert (paid["total_successful_payments_today"], paid["has_payment_failure_today_flag"], paid["payment_methods_used_today"], paid["payment_failure_codes_today"], paid["currency"]) == (10.0, 1, "CARD, PAYPAL", "NONE", "")
    assert (billing[D(2024, 1, 5)]["failed_invoices_today"], billing[D(2024, 1, 5)]["payment_methods_used_today"]) == (1, "NONE")


def test_snapshot_has_one_row_per_subscription_day(built):
    snapshot = built["fct_daily_user_snapshot"]
    assert len(snapshot.columns) == 52
    assert {r["subscription_id"]: r["count"] for r in snapshot.groupBy("subscription_id").count().collect()} == {10: 40, 20: 40, 21: 9}


def test_matrix_windows_span_eight_days_and_absent_users_are_left_out(built):
    matrix = built["churn_feature_matrix"]
    assert matrix.columns == wh.MATRIX_COLUMNS and len(wh.MATRIX_COLUMNS) == 63
    rows = {r["user_account_id"]: r for r in matrix.dropDuplicates(["user_account_id"]).collect()}
    assert set(rows) == {1, 2}
    one = rows[1]
    assert (one["trailing_7d_total_logins"], one["trailing_30d_failed_logins_count"], one["lifetime_total_failed_logins"]) == (1, 1, 2)
    assert one["login_frequency_drop_ratio_7d"] == pytest.approx((1 / 7) / (2 / 40))
    assert one["lifetime_avg_daily_active_minutes"] == pytest.approx(1200 / 60 / 40) and one["trailing_7d_avg_active_minutes"] == 0.0
    assert (one["is_churned"], one["customer_tenure_days"], one["lifetime_total_active_days_observed"]) == (1, 39, 40)
    two = rows[2]
    assert (two["is_churned"], two["lifetime_total_active_days_observed"], two["active_minutes_drop_ratio_7d"], two["currency"]) == (0, 40, 0.0, "UNKNOWN")
    assert matrix.filter("user_account_id = 2").count() == 2


def test_anchors_from_intervals_equal_anchors_from_days(raw, built):
    by_days = sorted(tuple(r) for r in wh.timeline_anchors(built["fct_daily_user_snapshot"]).collect())
    by_spans = sorted(tuple(r) for r in wh.interval_anchors(wh.subscription_intervals(raw, AS_OF), AS_OF).collect())
    assert by_days == by_spans


def test_matrix_from_facts_equals_matrix_from_snapshot(built):
    again = wh.churn_feature_matrix(built["fct_daily_user_snapshot"], built["dim_users"])
    assert again.dtypes == built["churn_feature_matrix"].dtypes
    rows = lambda df: sorted([[round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()], key=str)
    assert rows(again) == rows(built["churn_feature_matrix"])


def test_lifetime_sums_equal_snapshot_sums(built):
    total = built["churn_feature_matrix"].filter("user_account_id = 1").agg(F.sum("lifetime_total_revenue_contributed")).first()[0]
    assert total == built["fct_daily_user_snapshot"].filter("user_account_id = 1").agg(F.sum("daily_successful_payments_collected")).first()[0] == 10.0


def test_timeline_can_stop_at_the_cancellation(raw):
    full = wh.build_all(raw, AS_OF, stop_at_cancel=True)
    days = full["fct_daily_user_snapshot"].filter("subscription_id = 10")
    assert days.agg(F.max("activity_date")).first()[0] == D(2024, 2, 5) and days.count() == 36
    one = full["churn_feature_matrix"].filter("user_account_id = 1").first()
    assert (one["is_churned"], one["lifetime_total_active_days_observed"], one["trailing_7d_total_logins"]) == (1, 36, 2)


def test_many_subscriptions_do_not_multiply_rows(spark):
    """10 000 subscriptions of one user over one year: the stream has a row per day, and equals counting every pair."""
    import random
    rng = random.Random(3)
    spans = [(i, 1, D(2024, 1, 1) + dt.timedelta(rng.randrange(300)), rng.randrange(60)) for i in range(10_000)]
    df = spark.createDataFrame([(s, u, a, a + dt.timedelta(n), 0) for s, u, a, n in spans], "subscription_id long, user_account_id long, span_from date, span_to date, cancelled int")
    days = [D(2023, 12, 1) + dt.timedelta(n) for n in range(0, 450, 3)]
    facts = spark.createDataFrame([(1, d, 2) for d in days], "user_account_id long, activity_date date, clicks int")
    stream = wh.user_timeline(wh.span_changes(df), facts)
    rows = stream.collect()
    assert len(rows) <= 2 * 450 and stream.agg(F.sum("lasting")).first()[0] == (max(r["activity_date"] for r in rows) - min(r["activity_date"] for r in rows)).days
    got = {r["activity_date"]: r["open"] for r in rows if r["clicks"]}
    assert got == {d: sum(a <= d <= a + dt.timedelta(n) for _, _, a, n in spans) for d in days}
    plan = wh.user_timeline(wh.span_changes(df), facts)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ENSURE_REQUIREMENTS") == 2    # the changes by user and day, the stream by user


def test_layers_in_equal_buckets_join_without_an_exchange(spark, raw, built):
    tables = wh.write_bucketed_warehouse(raw, AS_OF, "tidemark_layers", 4)
    try:
        kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            snapshot = wh.fct_daily_user_snapshot(*[tables[name] for name in wh.BUCKETED[1:]])
            matrix = wh.churn_feature_matrix(tables["fct_daily_user_snapshot"], tables["dim_users"])
            for df in (snapshot, matrix):
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" in plan and "Exchange" not in plan
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        rows = lambda df: sorted([[round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()], key=str)
        for name in ("fct_daily_user_snapshot", "churn_feature_matrix"):
            assert rows(tables[name].select(*built[name].columns)) == rows(built[name])
    finally:
        spark.sql("DROP DATABASE tidemark_layers CASCADE")


def test_zeros_are_rounded_without_a_decimal(spark):
    """Quiet days are zeros: their rounding is decided before the exact one, whose result all other values keep."""
    from tidemark.catalogue.base import r4
    from tidemark.catalogue.warehouse import round_doubles
    df = spark.createDataFrame([(v,) for v in (0.0, -0.0, None, float("nan"), float("inf"), 1e300, 1.00005, -2.34565, 1e-12, -1e-6)], "v double")
    got, exact = [[str(r.v) for r in d.collect()] for d in (round_doubles(df), df.select(r4("v").alias("v")))]
    assert got == exact
    plan = round_doubles(df)._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN (v" in plan and "THEN 0.0" in plan
