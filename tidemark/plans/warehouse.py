"""Raw tables to daily facts, user dimension, daily snapshot and feature matrix.

Every function takes DataFrames and returns one. Aggregation comes before every join, so exchanges
carry rollups and not events; the matrix is keyed by user throughout.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import (
    contains_rules, count_where, distinct_list, fill_defaults, flag, guarded_ratio, half_up, json_text,
    mean_seconds, present_flag, seconds_between, sum_where,
)
from tidemark.operators.intervals import interval_days, state_intervals
from tidemark.operators.joins import full_outer_daily, left_join_many, scalar_lookup
from tidemark.sources.readers import read_layer
from tidemark.sources.sinks import create_database, create_table_as, write_layer

USER, DAY, SUBSCRIPTION = "user_account_id", "activity_date", "subscription_id"

# Names and labels of the source system.
CLICK_COLUMNS = {
    "apply_filter": "apply_filter_clicks",
    "click_export": "click_export_clicks",
    "frequent_refresh": "frequent_refresh_clicks",
    "open_subscription_settings": "open_subscription_settings_clicks",
    "run_report": "run_report_clicks",
    "save_project": "save_project_clicks",
    "submit_form": "submit_form_clicks",
    "update_payment_method": "update_payment_method_clicks",
}
SCREEN_COLUMNS = {
    "HOME": "home_screen_views",
    "BILLING": "billing_screen_views",
    "REPORTS": "report_screen_views",
    "WORKSPACE": "workspace_screen_views",
}
# Output column: (source column, aggregate, decimal places).
SPEED_COLUMNS = {
    "avg_first_contentful_paint_ms": ("first_contentful_paint_ms", F.avg, 0),
    "largest_contentful_paint_ms": ("largest_contentful_paint_ms", F.max, 0),
    "avg_cumulative_layout_shift": ("cumulative_layout_shift", F.avg, 2),
    "avg_time_to_interactive_ms": ("time_to_interactive_ms", F.avg, 0),
    "avg_dom_load_time_ms": ("dom_load_time_ms", F.avg, 0),
    "avg_api_wait_time_ms": ("api_wait_time_ms", F.avg, 0),
    "avg_render_time_ms": ("render_time_ms", F.avg, 0),
}
AGENT_PLATFORMS = (("Android", "Android"), ("iPhone", "IOS"), ("Windows", "WEB"))
FLAG_VARIANTS = {
    "pdf_generation_variant": "pdf-generation-v2",
    "advance_search_elastic_variant": "advanced-search-elastic",
}


def _rows(column: str, name: str):
    return F.count(column).alias(name)


# ---------------------------------------------------------------- user profile


def login_rollup(logins: DataFrame) -> DataFrame:
    result = F.col("authentication_result")
    return logins.groupBy(USER).agg(
        _rows("login_event_id", "total_logins"),
        count_where(result == "SUCCESS").alias("successful_logins"),
        count_where(result == "FAILURE").alias("failed_logins"),
        half_up(F.avg("risk_score_raw"), 3).alias("avg_authentication_risk_score"))


def token_rollup(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(USER).agg(
        _rows("session_id", "total_auth_sessions"),
        mean_seconds("session_started_at", "session_terminated_at").alias("avg_auth_session_duration_sec"))


def session_rollup(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(USER).agg(
        F.countDistinct("anonymous_device_id").alias("device_count"),
        distinct_list("device_model").alias("device_models"))


def exposure_rollup(exposures: DataFrame) -> DataFrame:
    """Key/value exposures to one column per flag."""
    variants = [F.max(F.when(F.col("feature_flag_key") == key, F.col("variant_key"))).alias(name)
                for name, key in FLAG_VARIANTS.items()]
    return exposures.groupBy(USER).agg(F.max(json_text("exposure_context_json", "user_tier")).alias("user_tier"), *variants)


def carrier_rollup(mobile_events: DataFrame) -> DataFrame:
    return mobile_events.groupBy(USER).agg(
        F.max(json_text("event_payload", "network_carrier", "phrase")).alias("network_carrier"))


def ticket_rollup(tickets: DataFrame) -> DataFrame:
    status = F.col("ticket_status")
    return tickets.groupBy(USER).agg(
        _rows("ticket_id", "total_tickets"), count_where(status == "OPEN").alias("open_tickets"),
        count_where(status == "CLOSED").alias("closed_tickets"))


def feedback_rollup(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(USER).agg(
        _rows("feedback_id", "total_feedbacks"), half_up(F.avg("rating_value"), 2).alias("avg_rating"))


def account_attributes(accounts: DataFrame) -> DataFrame:
    dates = {"account_creation_date": "created_at", "account_update_date": "updated_at",
             "last_successful_login_at": "last_successful_login_at", "account_deletion_date": "deleted_at"}
    return accounts.select(
        USER, "external_user_uuid", F.col("email_normalized").alias("email"), "locale_code",
        F.col("timezone_name").alias("timezone"), present_flag("email_verified_at").alias("email_verification_flag"),
        F.col("account_status_enum").alias("account_status"), "registration_source",
        flag(F.col("marketing_opt_in_flag")).alias("marketing_opt_in_flag"),
        *[F.to_date(source).alias(name) for name, source in dates.items()],
        flag(F.col("is_deleted")).alias("account_deletion_flag"))


def person_attributes(profiles: DataFrame) -> DataFrame:
    attributes = "profile_attributes_json"
    return profiles.select(
        USER, F.col("display_name").alias("user_name"), "phone_number", F.col("country_code").alias("country"),
        "company_name", "job_title", F.col("industry_code").alias("industry_type"), "employee_count_range",
        "annual_revenue_range", json_text(attributes, "theme").alias("profile_theme"),
        flag(json_text(attributes, "onboarding_completed") == "true").alias("onboarding_completed_flag"))


def plan_attributes(subscriptions: DataFrame) -> DataFrame:
    dates = {"trial_start_date": "trial_started_at", "trial_end_date": "trial_ends_at",
             "subscription_start_date": "subscription_started_at", "subscription_end_date": "subscription_ended_at",
             "cancellation_request_date": "cancellation_requested_at"}
    return subscriptions.select(
        USER, SUBSCRIPTION, "subscription_plan_code", "subscription_status", "billing_cycle",
        flag(F.col("auto_renew_enabled")).alias("auto_renew_flag"),
        *[F.to_date(source).alias(name) for name, source in dates.items()],
        "cancellation_reason_code", "cancellation_comment")


# The profile's columns in order.
PROFILE_COLUMNS = [
    "user_account_id", "external_user_uuid", "user_name", "email", "phone_number", "country", "locale_code", "timezone",
    "company_name", "job_title", "industry_type", "employee_count_range", "annual_revenue_range", "email_verification_flag",
    "account_status", "registration_source", "marketing_opt_in_flag", "profile_theme", "onboarding_completed_flag",
    "subscription_id", "subscription_plan_code", "subscription_status", "billing_cycle", "auto_renew_flag", "user_tier",
    "currency", "total_assigned_experiments", "pdf_generation_variant", "advance_search_elastic_variant", "total_logins",
    "successful_logins", "failed_logins", "avg_authentication_risk_score", "total_auth_sessions", "avg_auth_session_duration_sec",
    "device_count", "device_models", "network_carrier", "total_tickets", "open_tickets", "closed_tickets", "total_feedbacks",
    "avg_rating", "account_creation_date", "account_update_date", "last_successful_login_at", "trial_start_date",
    "trial_end_date", "subscription_start_date", "subscription_end_date", "cancellation_request_date", "cancellation_reason_code",
    "cancellation_comment", "account_deletion_date", "account_deletion_flag",
]
PROFILE_DEFAULTS = {
    "subscription_plan_code": "UNSUBSCRIBED", "subscription_status": "UNSUBSCRIBED", "billing_cycle": "NA",
    "network_carrier": "Unknown", "total_tickets": 0, "open_tickets": 0, "closed_tickets": 0, "total_feedbacks": 0,
    "cancellation_reason_code": "NA", "cancellation_comment": "NA",
}


def user_profiles(raw: Mapping[str, DataFrame]) -> DataFrame:
    """One row per account and subscription; login totals of users without logins stay NULL."""
    rollups = [
        person_attributes(raw["app_user_profiles"]),
        raw["user_master_profiles"].select(USER, F.col("currency_code").alias("currency")),
        login_rollup(raw["auth_login_events"]),
        token_rollup(raw["auth_session_tokens"]),
        raw["experiment_assignments"].groupBy(USER).agg(_rows("assignment_id", "total_assigned_experiments")),
        exposure_rollup(raw["feature_flag_exposures"]),
        carrier_rollup(raw["mobile_application_events"]),
        session_rollup(raw["product_sessions"]),
        ticket_rollup(raw["support_tickets"]),
        feedback_rollup(raw["user_feedback_submissions"]),
    ]
    # Subscriptions come first: a user with very many of them is then on the left side of every
    # later join, where AQE can split the rows.
    wide = left_join_many(account_attributes(raw["app_user_accounts"]), plan_attributes(raw["subscription_accounts"]), [USER])
    for rollup in rollups:
        wide = wide.join(rollup, USER, "left")
    return fill_defaults(wide, PROFILE_DEFAULTS).select(*PROFILE_COLUMNS)


# ---------------------------------------------------------------- daily facts


def subscription_intervals(raw: Mapping[str, DataFrame], as_of: dt.date, stop_at_cancel: bool = False) -> DataFrame:
    """Validity intervals with their user and plan.

    By default the timeline goes on after a cancellation, as in the source definition.
    ``stop_at_cancel`` ends it on the first cancelled day, so no later day leaks into the features.
    """
    accounts = raw["subscription_accounts"].select(SUBSCRIPTION, USER, "subscription_plan_code", "billing_cycle")
    states = state_intervals(raw["subscription_state_history"], SUBSCRIPTION, "effective_at",
                             "subscription_state_id", "new_state", as_of)
    if stop_at_cancel:
        cancelled = F.when(F.col("new_state") == "CANCELLED", F.col("valid_from"))
        ended = states.withColumn("ended", F.min(cancelled).over(Window.partitionBy(SUBSCRIPTION)))
        states = ended.filter(F.col("ended").isNull() | (F.col("valid_from") <= F.col("ended"))).withColumn(
            "valid_to", F.least("valid_to", "ended")).drop("ended")
    return states.withColumnRenamed("new_state", "subscription_status").join(accounts, SUBSCRIPTION)


def subscription_lifecycle_daily(raw: Mapping[str, DataFrame], as_of: dt.date, stop_at_cancel: bool = False) -> DataFrame:
    days = interval_days(subscription_intervals(raw, as_of, stop_at_cancel), as_of, DAY)
    return days.select(SUBSCRIPTION, USER, DAY, "subscription_plan_code", "billing_cycle", "subscription_status")


def click_rollup(clicks: DataFrame) -> DataFrame:
    """Clickstream to one row per session."""
    return clicks.groupBy("product_session_id").agg(
        _rows("event_id", "total_events"),
        *[count_where(F.col("event_name") == event).alias(name) for event, name in CLICK_COLUMNS.items()],
        *[count_where(F.col("page_screen_name") == screen).alias(name) for screen, name in SCREEN_COLUMNS.items()],
        half_up(F.avg("latency_ms"), 0).alias("session_latency"), distinct_list("geo_city").alias("session_cities"))


def speed_rollup(speed: DataFrame) -> DataFrame:
    """Performance rows to one row per session: row count, and total and filled count per measure."""
    measures = []
    for source, measure, _ in SPEED_COLUMNS.values():
        value = F.col(source).cast("double")
        measures += [F.max(value).alias(f"max_{source}")] if measure is F.max else [
            F.sum(value).alias(f"sum_{source}"), F.count(value).alias(f"count_{source}")]
    return speed.groupBy("product_session_id").agg(F.count(F.lit(1)).alias("copies"), *measures)


def product_daily(sessions: DataFrame, speed: DataFrame, clicks: DataFrame) -> DataFrame:
    """Sessions that have both clicks and performance rows, rolled up to user-days.

    By definition a session counts once per performance row. The repetition is a weight here, so
    both event tables shrink to one row per session before the joins and no session can be hot.
    """
    totals = ["total_events", *CLICK_COLUMNS.values(), *SCREEN_COLUMNS.values()]
    sessions = sessions.select("product_session_id", USER, "session_started_at", "session_ended_at", "created_at",
                               "device_model", "browser_name", "platform_type")
    joined = sessions.join(click_rollup(clicks), "product_session_id").join(speed_rollup(speed), "product_session_id")
    copies = F.col("copies")

    def weighted_mean(column: str):
        filled = F.sum(F.when(F.col(column).isNotNull(), copies))
        return F.sum(F.col(column) * copies) / F.nullif(filled, F.lit(0))

    speeds = [half_up(F.max(f"max_{source}") if measure is F.max
                      else F.sum(f"sum_{source}") / F.nullif(F.sum(f"count_{source}"), F.lit(0)), places).alias(name)
              for name, (source, measure, places) in SPEED_COLUMNS.items()]
    return joined.groupBy(USER, F.to_date("created_at").alias(DAY)).agg(
        F.sum(seconds_between("session_started_at", "session_ended_at") * copies).alias("total_duration_sec"),
        F.size(F.collect_set("device_model")).cast("long").alias("total_devices_used"),
        distinct_list("device_model").alias("device_models"), distinct_list("browser_name").alias("browsers_used"),
        distinct_list("platform_type").alias("platform_types"), F.max("session_cities").alias("geo_city"),
        *[F.sum(F.col(name) * copies).alias(name) for name in totals],
        half_up(weighted_mean("session_latency"), 0).alias("avg_latency"), *speeds)


def logins_daily(logins: DataFrame) -> DataFrame:
    """Logins per user-day. A day on one known device keeps its fingerprint, which is all that the device table can be asked for."""
    agent, fingerprint = "user_agent_string", F.col("device_fingerprint_hash")
    known = [(needle, fingerprint) for needle, _ in AGENT_PLATFORMS]
    device = contains_rules(agent, known, "")        # no text for an agent that no rule knows: it makes the day's list one that no device has
    result = F.col("authentication_result")
    return logins.groupBy(USER, F.to_date("created_at").alias(DAY)).agg(
        _rows("login_event_id", "total_login_attempts"),
        count_where(result == "SUCCESS").alias("successful_logins_count"),
        count_where(result == "FAILURE").alias("failed_logins_count"), F.max("geo_city").alias("login_geo_city"),
        F.when((F.min(device) == F.max(device)) & (F.min(device) != ""), F.min(device)).alias("login_device"),
        distinct_list(contains_rules(agent, AGENT_PLATFORMS, "UNKNOWN_PLATFORM")).alias("login_platform_types"))


def tokens_daily(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(USER, F.to_date("session_started_at").alias(DAY)).agg(
        _rows("session_id", "sessions_created_count"),
        count_where(F.col("termination_reason") == "USER_LOGOUT").alias("manual_logouts_count"))


ACTIVITY_MEASURES = [
    "total_login_attempts", "successful_logins_count", "failed_logins_count", "sessions_created_count",
    "manual_logouts_count", "total_duration_sec", "total_devices_used",
]
ACTIVITY_TRAITS = ["device_models", "browsers_used", "platform_types", "geo_city"]
ACTIVITY_TELEMETRY = ["total_events", *CLICK_COLUMNS.values(), *SCREEN_COLUMNS.values(), "avg_latency", *SPEED_COLUMNS]


def user_activity_daily(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Product use, logins and auth sessions per user-day; traits missing in sessions come from logins."""
    product = product_daily(raw["product_sessions"], raw["frontend_performance_events"], raw["clickstream_events"])
    joined = full_outer_daily(full_outer_daily(product, logins_daily(raw["auth_login_events"]), [USER, DAY]),
                              tokens_daily(raw["auth_session_tokens"]), [USER, DAY])
    joined = scalar_lookup(joined, raw["user_device_profiles"], "login_device", "device_id",
                           {"looked_up_model": "device_model", "looked_up_browser": "browser_name"})
    fallback = {"device_models": "looked_up_model", "browsers_used": "looked_up_browser",
                "platform_types": "login_platform_types", "geo_city": "login_geo_city"}
    joined = joined.withColumns({name: F.coalesce(name, other) for name, other in fallback.items()})
    filled = fill_defaults(joined, {name: 0 for name in [*ACTIVITY_MEASURES, *ACTIVITY_TELEMETRY]})
    return filled.select(USER, DAY, *ACTIVITY_MEASURES, *ACTIVITY_TRAITS, *ACTIVITY_TELEMETRY)


SUPPORT_MEASURES = ["tickets_opened_today", "high_priority_tickets_today", "active_open_tickets_today",
                    "total_ticket_events_today", "agent_replies_today", "ticket_escalations_today"]


def customer_support_daily(raw: Mapping[str, DataFrame]) -> DataFrame:
    tickets = raw["support_tickets"]
    opened = tickets.groupBy(USER, F.to_date("created_at").alias(DAY)).agg(
        _rows("ticket_id", "tickets_opened_today"),
        count_where(F.col("ticket_priority") == "HIGH").alias("high_priority_tickets_today"),
        count_where(F.col("ticket_status") == "OPEN").alias("active_open_tickets_today"))
    # Events shrink to one row per ticket and day before they meet their ticket.
    per_ticket = raw["support_ticket_events"].groupBy("ticket_id", F.to_date("created_at").alias(DAY)).agg(
        _rows("ticket_event_id", "total_ticket_events_today"),
        count_where(F.col("event_type") == "AGENT_COMMENT").alias("agent_replies_today"),
        count_where(F.col("event_type") == "ESCALATION").alias("ticket_escalations_today"))
    worked = per_ticket.join(tickets.select("ticket_id", USER), "ticket_id").groupBy(USER, DAY).agg(
        *[F.sum(name).alias(name) for name in SUPPORT_MEASURES[3:]])
    return full_outer_daily(opened, worked, [USER, DAY], {name: 0 for name in SUPPORT_MEASURES}).select(
        USER, DAY, *SUPPORT_MEASURES)


BILLING_DEFAULTS = {
    "total_invoices_generated_today": 0, "total_amount_invoiced_today": 0.0, "total_tax_invoiced_today": 0.0,
    "currency": "", "failed_invoices_today": 0, "total_successful_payments_today": 0.0,
    "has_payment_failure_today_flag": 0, "payment_methods_used_today": "NONE", "payment_failure_codes_today": "NONE",
}


def billing_and_revenue_daily(raw: Mapping[str, DataFrame]) -> DataFrame:
    invoices = raw["billing_invoices"]
    billed = invoices.groupBy(SUBSCRIPTION, F.to_date("created_at").alias(DAY)).agg(
        _rows("invoice_id", "total_invoices_generated_today"), F.sum("total_amount").alias("total_amount_invoiced_today"),
        F.sum("tax_amount").alias("total_tax_invoiced_today"), F.max("currency_code").alias("currency"),
        count_where(F.col("invoice_status") == "FAILED").alias("failed_invoices_today"))
    status = F.col("transaction_status")
    # Payments shrink to one row per invoice, day, method and failure code before the bridge join.
    per_invoice = raw["payment_transactions"].groupBy(
        "invoice_id", F.to_date("initiated_at").alias(DAY), "payment_method_type", "failure_code").agg(
        sum_where(status == "SUCCESS", "amount").alias("collected"), F.max(flag(status == "FAILED")).alias("failed"))
    paid = per_invoice.join(invoices.select("invoice_id", SUBSCRIPTION), "invoice_id").groupBy(SUBSCRIPTION, DAY).agg(
        F.sum("collected").alias("total_successful_payments_today"), F.max("failed").alias("has_payment_failure_today_flag"),
        distinct_list("payment_method_type").alias("payment_methods_used_today"),
        distinct_list("failure_code").alias("payment_failure_codes_today"))
    return full_outer_daily(billed, paid, [SUBSCRIPTION, DAY], BILLING_DEFAULTS).select(SUBSCRIPTION, DAY, *BILLING_DEFAULTS)


# ---------------------------------------------------------------- mart

# The dimension's columns in order.
DIM_COLUMNS = [
    "user_account_id", "external_user_uuid", "country", "locale_code", "timezone", "company_name", "job_title", "industry_type",
    "employee_count_range", "annual_revenue_range", "account_status", "registration_source", "profile_theme",
    "email_verification_flag", "marketing_opt_in_flag", "onboarding_completed_flag", "subscription_id", "user_tier", "currency",
    "subscription_plan_code", "subscription_status", "billing_cycle", "auto_renew_flag", "pdf_generation_variant",
    "advance_search_elastic_variant", "avg_authentication_risk_score", "device_models", "network_carrier", "avg_rating",
    "account_creation_date", "account_update_date", "last_successful_login_at", "trial_start_date", "trial_end_date",
    "subscription_start_date", "subscription_end_date", "cancellation_request_date", "cancellation_reason_code",
    "cancellation_comment", "account_deletion_date", "account_deletion_flag",
]


def dim_users(profiles: DataFrame) -> DataFrame:
    return fill_defaults(profiles.select(*DIM_COLUMNS), {SUBSCRIPTION: 0, "auto_renew_flag": -1})


# Snapshot column: (fact column, default). Fixed values.
SNAPSHOT_ACTIVITY = {
    "daily_login_attempts": ("total_login_attempts", 0), "daily_successful_logins": ("successful_logins_count", 0),
    "daily_failed_logins": ("failed_logins_count", 0), "daily_sessions_created": ("sessions_created_count", 0),
    "daily_manual_logouts": ("manual_logouts_count", 0), "daily_total_duration_sec": ("total_duration_sec", 0),
    "daily_devices_active_count": ("total_devices_used", 0), "daily_device_models_used": ("device_models", "NONE"),
    "daily_browsers_used": ("browsers_used", "NONE"), "daily_platform_types_used": ("platform_types", "NONE"),
    "daily_geo_city_location": ("geo_city", "UNKNOWN"), "daily_total_clickstream_events": ("total_events", 0),
    **{f"daily_{name}": (name, 0) for name in [*CLICK_COLUMNS.values(), *SCREEN_COLUMNS.values()]},
    "daily_avg_latency_ms": ("avg_latency", 0), **{f"daily_{name}": (name, 0) for name in SPEED_COLUMNS},
}
SNAPSHOT_SUPPORT = {
    "daily_support_tickets_opened": ("tickets_opened_today", 0),
    "daily_high_priority_tickets_opened": ("high_priority_tickets_today", 0),
    "daily_active_open_tickets_count": ("active_open_tickets_today", 0),
    "daily_total_ticket_lifecycle_events": ("total_ticket_events_today", 0),
    "daily_agent_replies_received": ("agent_replies_today", 0),
    "daily_ticket_escalations_triggered": ("ticket_escalations_today", 0),
}
SNAPSHOT_BILLING = {
    "daily_invoices_generated": ("total_invoices_generated_today", 0),
    "daily_amount_invoiced": ("total_amount_invoiced_today", 0), "daily_tax_invoiced": ("total_tax_invoiced_today", 0),
    "daily_failed_invoices_count": ("failed_invoices_today", 0),
    "daily_successful_payments_collected": ("total_successful_payments_today", 0),
    "daily_payment_failed_flag": ("has_payment_failure_today_flag", 0),
    "daily_payment_methods_used": ("payment_methods_used_today", "NONE"),
    "daily_payment_failure_codes": ("payment_failure_codes_today", "NONE"),
}


def fct_daily_user_snapshot(spine: DataFrame, activity: DataFrame, support: DataFrame, billing: DataFrame) -> DataFrame:
    """Every subscription-day with what happened on it; quiet days hold zeros."""
    columns = {**SNAPSHOT_ACTIVITY, **SNAPSHOT_SUPPORT, **SNAPSHOT_BILLING}
    # Bills that carry their user can meet a spine that lies by user where it is.
    billing_keys = [c for c in (USER, SUBSCRIPTION, DAY) if c in billing.columns]
    # Billing joins first: the spine comes partitioned by subscription, and its rows are still narrow
    # when they move to their users.
    joined = (spine.select(DAY, USER, SUBSCRIPTION, F.col("subscription_status").alias("historical_subscription_status"),
                           F.col("subscription_plan_code").alias("historical_subscription_plan_code"),
                           F.col("billing_cycle").alias("historical_billing_cycle"))
              .join(billing.select(*billing_keys, *[f for f, _ in SNAPSHOT_BILLING.values()]), billing_keys, "left")
              .join(activity.select(USER, DAY, *[f for f, _ in SNAPSHOT_ACTIVITY.values()]), [USER, DAY], "left")
              .join(support.select(USER, DAY, *[f for f, _ in SNAPSHOT_SUPPORT.values()]), [USER, DAY], "left"))
    filled = fill_defaults(joined, {fact: default for fact, default in columns.values()})
    return filled.select(DAY, USER, SUBSCRIPTION, "historical_subscription_status", "historical_subscription_plan_code",
                         "historical_billing_cycle", *[F.col(fact).alias(name) for name, (fact, _) in columns.items()])


# ---------------------------------------------------------------- feature matrix


def timeline_anchors(snapshot: DataFrame) -> DataFrame:
    """First and last day per user and whether any day was cancelled."""
    return snapshot.groupBy(USER).agg(
        F.min(DAY).alias("first_active_date"), F.max(DAY).alias("final_active_date"),
        F.max(flag(F.col("historical_subscription_status") == "CANCELLED")).alias("is_churned"))


def interval_anchors(intervals: DataFrame, as_of: dt.date) -> DataFrame:
    """The same anchors from the intervals themselves: no day is exploded for them."""
    last = F.least("valid_to", F.lit(as_of))
    return intervals.filter(F.col("valid_from") <= last).groupBy(USER).agg(
        F.min("valid_from").alias("first_active_date"), F.max(last).alias("final_active_date"),
        F.max(flag(F.col("subscription_status") == "CANCELLED")).alias("is_churned"))


# Matrix column: snapshot column. Fixed values.
LIFETIME_SUMS = {
    "lifetime_total_login_attempts": "daily_login_attempts",
    "lifetime_total_successful_logins": "daily_successful_logins",
    "lifetime_total_failed_logins": "daily_failed_logins",
    "lifetime_total_manual_logouts": "daily_manual_logouts",
    "lifetime_total_clickstream_events": "daily_total_clickstream_events",
    "lifetime_apply_filter_clicks": "daily_apply_filter_clicks",
    "lifetime_export_clicks": "daily_click_export_clicks",
    "lifetime_frequent_refresh_clicks": "daily_frequent_refresh_clicks",
    "lifetime_subscription_settings_clicks": "daily_open_subscription_settings_clicks",
    "lifetime_submit_form_clicks": "daily_submit_form_clicks",
    "lifetime_update_payment_method_clicks": "daily_update_payment_method_clicks",
    "lifetime_total_reports_run": "daily_run_report_clicks",
    "lifetime_total_projects_saved": "daily_save_project_clicks",
    "lifetime_home_screen_views": "daily_home_screen_views",
    "lifetime_billing_screen_views": "daily_billing_screen_views",
    "lifetime_report_screen_views": "daily_report_screen_views",
    "lifetime_workspace_screen_views": "daily_workspace_screen_views",
    "lifetime_total_support_tickets": "daily_support_tickets_opened",
    "lifetime_high_priority_tickets": "daily_high_priority_tickets_opened",
    "lifetime_agent_replies_recieved": "daily_agent_replies_received",
    "lifetime_total_ticket_escalations": "daily_ticket_escalations_triggered",
    "lifetime_total_invoices_generated": "daily_invoices_generated",
    "lifetime_total_failed_invoices": "daily_failed_invoices_count",
    "lifetime_total_revenue_contributed": "daily_successful_payments_collected",
}
LIFETIME_MEANS = {
    "lifetime_avg_latency_ms": "daily_avg_latency_ms",
    "lifetime_avg_api_wait_time_ms": "daily_avg_api_wait_time_ms",
    "lifetime_avg_cumulative_layout_shift": "daily_avg_cumulative_layout_shift",
    "lifetime_avg_dom_load_time_ms": "daily_avg_dom_load_time_ms",
    "lifetime_avg_first_contentful_paint_ms": "daily_avg_first_contentful_paint_ms",
    "lifetime_avg_render_time": "daily_avg_render_time_ms",
    "lifetime_avg_time_to_interactive_ms": "daily_avg_time_to_interactive_ms",
}
TRAILING_SUMS = {
    "trailing_7d_total_logins": (7, "daily_successful_logins"),
    "trailing_7d_total_clicks": (7, "daily_total_clickstream_events"),
    "trailing_7d_support_tickets": (7, "daily_support_tickets_opened"),
    "trailing_7d_active_open_tickets": (7, "daily_active_open_tickets_count"),
    "trailing_30d_failed_payments_count": (30, "daily_payment_failed_flag"),
    "trailing_30d_failed_logins_count": (30, "daily_failed_logins"),
}
MATRIX_ATTRIBUTES = {
    "country": "country", "industry_type": "industry_type", "employee_count_range": "employee_count_range",
    "annual_revenue_range": "annual_revenue_range", "registration_source": "registration_source",
    "registration_plan_code": "subscription_plan_code", "registration_billing_cycle": "billing_cycle",
    "pdf_generation_variant": "pdf_generation_variant",
    "advance_search_elastic_variant": "advance_search_elastic_variant", "network_carrier": "network_carrier",
    "avg_authentication_risk_score": "avg_authentication_risk_score", "avg_rating": "avg_rating",
    "email_verification_flag": "email_verification_flag", "marketing_opt_in_flag": "marketing_opt_in_flag",
    "onboarding_completed_flag": "onboarding_completed_flag",
}
# The matrix's columns in order.
MATRIX_COLUMNS = [
    "user_account_id", "country", "industry_type", "employee_count_range", "annual_revenue_range", "registration_source",
    "registration_plan_code", "registration_billing_cycle", "pdf_generation_variant", "advance_search_elastic_variant",
    "network_carrier", "avg_authentication_risk_score", "avg_rating", "email_verification_flag", "marketing_opt_in_flag",
    "onboarding_completed_flag", "customer_tenure_days", "lifetime_total_active_days_observed", "lifetime_total_login_attempts",
    "lifetime_total_successful_logins", "lifetime_total_failed_logins", "lifetime_total_manual_logouts",
    "lifetime_avg_daily_active_minutes", "lifetime_total_clickstream_events", "lifetime_apply_filter_clicks",
    "lifetime_export_clicks", "lifetime_frequent_refresh_clicks", "lifetime_subscription_settings_clicks",
    "lifetime_submit_form_clicks", "lifetime_update_payment_method_clicks", "lifetime_total_reports_run",
    "lifetime_total_projects_saved", "lifetime_home_screen_views", "lifetime_billing_screen_views",
    "lifetime_report_screen_views", "lifetime_workspace_screen_views", "lifetime_total_support_tickets",
    "lifetime_high_priority_tickets", "lifetime_agent_replies_recieved", "lifetime_total_ticket_escalations",
    "lifetime_total_invoices_generated", "lifetime_total_failed_invoices", "lifetime_total_revenue_contributed", "currency",
    "lifetime_avg_latency_ms", "lifetime_avg_api_wait_time_ms", "lifetime_avg_cumulative_layout_shift",
    "lifetime_avg_dom_load_time_ms", "lifetime_avg_first_contentful_paint_ms", "lifetime_largest_contentful_paint_ms",
    "lifetime_avg_render_time", "lifetime_avg_time_to_interactive_ms", "trailing_7d_avg_active_minutes",
    "trailing_7d_total_logins", "trailing_7d_total_clicks", "trailing_7d_support_tickets", "trailing_7d_active_open_tickets",
    "trailing_30d_failed_payments_count", "trailing_30d_failed_logins_count", "trailing_30d_avg_latency_ms",
    "active_minutes_drop_ratio_7d", "login_frequency_drop_ratio_7d", "is_churned",
]


def behaviour_features(snapshot: DataFrame, anchors: DataFrame) -> DataFrame:
    """Lifetime and trailing measures per user in one aggregation.

    The trailing windows count back from the user's own last day and include both ends, so "7 days"
    covers eight calendar days.
    """
    dated = snapshot.join(anchors.select(USER, "final_active_date"), USER)

    def within(days: int):
        return F.col(DAY) >= F.date_sub("final_active_date", days)

    def trailing_mean(days: int, column: str):
        return F.avg(F.when(within(days), F.col(column)))

    return dated.groupBy(USER).agg(
        F.countDistinct(DAY).alias("lifetime_total_active_days_observed"),
        (F.avg("daily_total_duration_sec") / 60.0).alias("lifetime_avg_daily_active_minutes"),
        *[F.sum(column).alias(name) for name, column in LIFETIME_SUMS.items()],
        *[F.avg(column).alias(name) for name, column in LIFETIME_MEANS.items()],
        F.max("daily_largest_contentful_paint_ms").alias("lifetime_largest_contentful_paint_ms"),
        (trailing_mean(7, "daily_total_duration_sec") / 60.0).alias("trailing_7d_avg_active_minutes"),
        trailing_mean(30, "daily_avg_latency_ms").alias("trailing_30d_avg_latency_ms"),
        *[sum_where(within(days), column).alias(name) for name, (days, column) in TRAILING_SUMS.items()])


def subscription_spans(intervals: DataFrame, as_of: dt.date) -> DataFrame:
    """First and last day of each subscription and whether any of its days is cancelled.

    The intervals of one subscription follow each other without a gap, so its days are one span.
    """
    last = F.least("valid_to", F.lit(as_of))
    return intervals.filter(F.col("valid_from") <= last).groupBy(SUBSCRIPTION, USER).agg(
        F.min("valid_from").alias("span_from"), F.max(last).alias("span_to"),
        F.max(flag(F.col("subscription_status") == "CANCELLED")).alias("cancelled"))


def span_changes(spans: DataFrame) -> DataFrame:
    """Per user and day by how much the number of open subscriptions changes; starts carry what the anchors need.

    However many subscriptions a user has, no more rows come out than there are days.
    """
    nothing = {"span_from": "date", "span_to": "date", "cancelled": "int"}
    start = F.struct(F.col("span_from").alias(DAY), F.lit(1).alias("change"), "span_from", "span_to", "cancelled")
    end = F.struct(F.date_add("span_to", 1).alias(DAY), F.lit(-1).alias("change"), *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()])
    return spans.select(USER, F.inline(F.array(start, end))).groupBy(USER, DAY).agg(
        F.sum("change").alias("change"), F.min("span_from").alias("first_active_date"),
        F.max("span_to").alias("final_active_date"), F.max("cancelled").alias("is_churned"))


def user_timeline(changes: DataFrame, *facts: DataFrame) -> DataFrame:
    """One ordered stream per user of span starts, span ends and daily facts, with the subscriptions open on each day.

    ``open`` is the running sum of the changes up to and including the day, ``lasting`` the days until the user's next
    row, over which it does not change (0 between rows of one day). Each input has one row per user and day, so a user
    has as many rows as the calendar has days, times the inputs: nobody is hot, and one exchange serves all.
    """
    stream = changes
    for fact in facts:
        stream = stream.unionByName(fact, allowMissingColumns=True)
    user, order = Window.partitionBy(USER), Window.partitionBy(USER).orderBy(DAY)
    return stream.withColumns({
        "open": F.coalesce(F.sum("change").over(order), F.lit(0)).cast("long"),     # rows of the same day count together
        "lasting": F.coalesce(F.datediff(F.lead(DAY).over(order), DAY), F.lit(0)),
        "final_active_date": F.max("final_active_date").over(user)})


def behaviour_from_facts(intervals: DataFrame, activity: DataFrame, support: DataFrame, billing: DataFrame,
                         as_of: dt.date) -> DataFrame:
    """The measures of ``behaviour_features`` and the timeline anchors, without a row per quiet day.

    Sums need only the days on which something happened, weighted by the subscriptions open on the day; averages divide
    by the number of subscription-days, which follows from how long each count of open subscriptions lasts. Both come
    from one sweep over the user's stream: no fact meets a span in a join, and the cost follows the facts.
    """
    spans = subscription_spans(intervals, as_of)
    used = {*LIFETIME_SUMS.values(), *LIFETIME_MEANS.values(), *[column for _, column in TRAILING_SUMS.values()], "daily_total_duration_sec", "daily_largest_contentful_paint_ms"}

    def by_day(facts: DataFrame, columns: Mapping[str, tuple]) -> DataFrame:
        return facts.select(USER, DAY, F.lit(True).alias("busy"), *[F.coalesce(F.col(fact), F.lit(0)).alias(name) for name, (fact, _) in columns.items() if name in used])

    # on a day with tickets only, every measure of use is 0
    tickets = by_day(support, SNAPSHOT_SUPPORT).withColumn("daily_largest_contentful_paint_ms", F.lit(0.0))
    billing_columns = {name: fact for name, (fact, _) in SNAPSHOT_BILLING.items()}
    billed = {*LIFETIME_SUMS.values(), *[column for _, column in TRAILING_SUMS.values()]} & set(billing_columns)
    timeline = user_timeline(span_changes(spans), by_day(activity, SNAPSHOT_ACTIVITY), tickets)
    # the last day with facts that an earlier row has; of several rows of one day only one is the first
    earlier = F.last(F.when(F.col("busy"), F.col(DAY)), ignorenulls=True).over(Window.partitionBy(USER).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1))
    timeline = timeline.withColumn("first_busy", F.col("busy") & (earlier.isNull() | (earlier < F.col(DAY)))).filter(F.col("final_active_date").isNotNull())

    def within(back: int):
        return F.col(DAY) >= F.date_sub("final_active_date", back)

    def total(column: str):
        return F.sum(F.col(column) * F.col("open"))

    def recent_total(back: int, column: str):
        return sum_where(within(back) & F.col(column).isNotNull(), F.col(column) * F.col("open"))

    def spine_days(back: int):
        start = F.greatest(F.lit(0), F.datediff(F.date_sub("final_active_date", back), DAY))
        return F.sum(F.greatest(F.col("lasting") - start, F.lit(0)) * F.col("open"))

    is_open = F.col("open") > 0
    rolled = timeline.groupBy(USER).agg(
        F.min("first_active_date").alias("first_active_date"), F.max("final_active_date").alias("final_active_date"), F.max("is_churned").alias("is_churned"),
        F.sum(F.when(is_open, F.col("lasting")).otherwise(0)).alias("lifetime_total_active_days_observed"),
        F.sum(F.col("lasting") * F.col("open")).alias("n_all"), spine_days(7).alias("n_7"), spine_days(30).alias("n_30"),
        *[total(column).alias(name) for name, column in LIFETIME_SUMS.items() if column not in billed],
        *[total(column).alias(f"t_{name}") for name, column in {**LIFETIME_MEANS, "minutes": "daily_total_duration_sec"}.items()],
        recent_total(7, "daily_total_duration_sec").alias("t_minutes_7"), recent_total(30, "daily_avg_latency_ms").alias("t_latency_30"),
        *[recent_total(*rule).alias(name) for name, rule in TRAILING_SUMS.items() if rule[1] not in billed],
        F.max(F.when(is_open, F.col("daily_largest_contentful_paint_ms"))).alias("largest"),
        F.sum(F.when(F.col("first_busy"), F.col("open"))).alias("busy_days"))

    def mean(column: str, count: str):
        return F.coalesce(F.col(column), F.lit(0.0)) / F.nullif(F.col(count), F.lit(0))

    # a bill counts on the days of its own subscription, once, so it needs no weight
    final = spans.groupBy(USER).agg(F.max("span_to").alias("final_active_date"))
    paid = (billing.select(SUBSCRIPTION, DAY, *[F.col(billing_columns[name]).alias(name) for name in sorted(billed)])
            .join(spans.select(SUBSCRIPTION, USER, "span_from", "span_to").join(final, USER), SUBSCRIPTION)
            .filter(F.col(DAY).between(F.col("span_from"), F.col("span_to"))).groupBy(USER).agg(
        *[F.sum(column).alias(name) for name, column in LIFETIME_SUMS.items() if column in billed],
        *[sum_where(within(back), column).alias(name) for name, (back, column) in TRAILING_SUMS.items() if column in billed]))
    quiet = F.coalesce("busy_days", F.lit(0)) < F.col("n_all")
    return rolled.join(paid, USER, "left").select(
        USER, "first_active_date", "final_active_date", "is_churned",
        "lifetime_total_active_days_observed", (mean("t_minutes", "n_all") / 60.0).alias("lifetime_avg_daily_active_minutes"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in LIFETIME_SUMS],
        *[mean(f"t_{name}", "n_all").alias(name) for name in LIFETIME_MEANS],
        F.when(quiet, F.greatest("largest", F.lit(0.0))).otherwise(F.col("largest")).alias("lifetime_largest_contentful_paint_ms"),
        (mean("t_minutes_7", "n_7") / 60.0).alias("trailing_7d_avg_active_minutes"),
        mean("t_latency_30", "n_30").alias("trailing_30d_avg_latency_ms"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in TRAILING_SUMS])


def churn_feature_matrix(snapshot: DataFrame, dimension: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """The matrix from a (written) snapshot: one row of 63 columns per dimension row with at least one subscription-day."""
    anchors = timeline_anchors(snapshot) if anchors is None else anchors
    return assemble_matrix(dimension, anchors.join(behaviour_features(snapshot, anchors), USER))


def assemble_matrix(dimension: DataFrame, behaviour: DataFrame) -> DataFrame:
    """Join each dimension row with its user's anchors and measures."""
    joined = dimension.join(behaviour, USER)
    logins_per_day = guarded_ratio("lifetime_total_successful_logins", "lifetime_total_active_days_observed")
    computed = joined.withColumns({
        "currency": F.coalesce("currency", F.lit("UNKNOWN")),
        "customer_tenure_days": F.datediff("final_active_date", "account_creation_date"),
        "active_minutes_drop_ratio_7d": guarded_ratio("trailing_7d_avg_active_minutes", "lifetime_avg_daily_active_minutes"),
        "login_frequency_drop_ratio_7d": guarded_ratio(F.col("trailing_7d_total_logins") / 7.0, logins_per_day),
        **{name: F.col(source) for name, source in MATRIX_ATTRIBUTES.items() if name != source}})
    means = [*LIFETIME_MEANS, "lifetime_avg_daily_active_minutes", "lifetime_largest_contentful_paint_ms",
             "trailing_7d_avg_active_minutes", "trailing_30d_avg_latency_ms"]
    return fill_defaults(computed.select(*MATRIX_COLUMNS), {name: 0.0 for name in means})


def build_all(raw: Mapping[str, DataFrame], as_of: dt.date, stop_at_cancel: bool = False) -> dict[str, DataFrame]:
    """The eight derived tables, composed lazily.

    The matrix is computed from the daily facts and the intervals. ``churn_feature_matrix`` gives
    the same rows from a written snapshot.
    """
    profiles = user_profiles(raw)
    spine = subscription_lifecycle_daily(raw, as_of, stop_at_cancel)
    activity, support, billing = user_activity_daily(raw), customer_support_daily(raw), billing_and_revenue_daily(raw)
    dimension = dim_users(profiles)
    snapshot = fct_daily_user_snapshot(spine, activity, support, billing)
    intervals = subscription_intervals(raw, as_of, stop_at_cancel)
    matrix = assemble_matrix(dimension, behaviour_from_facts(intervals, activity, support, billing, as_of))
    return {
        "user_profiles": profiles, "subscription_lifecycle_daily": spine, "user_activity_daily": activity,
        "customer_support_daily": support, "billing_and_revenue_daily": billing, "dim_users": dimension,
        "fct_daily_user_snapshot": snapshot, "churn_feature_matrix": matrix,
    }


def write_warehouse(raw: Mapping[str, DataFrame], as_of: dt.date, root: str, stop_at_cancel: bool = False) -> dict[str, DataFrame]:
    """Write the three layers below ``root`` and return the written tables.

    Each layer is built from the written one before it, so nothing is computed twice and a failed
    job restarts at its layer. Daily tables are partitioned by day and sorted by entity within their
    files, which keeps column statistics narrow; no global sort is made.
    """
    spark = next(iter(raw.values())).sparkSession
    lazy = build_all(raw, as_of, stop_at_cancel)
    daily = {name: [DAY] for name in lazy if name.endswith("_daily") or name == "fct_daily_user_snapshot"}
    inner = ["user_profiles", "subscription_lifecycle_daily", "user_activity_daily", "customer_support_daily", "billing_and_revenue_daily"]
    write_layer({name: lazy[name] for name in inner}, f"{root}/int", daily, {name: [SUBSCRIPTION if "subscription" in name or "billing" in name else USER] for name in daily})
    facts = read_layer(spark, f"{root}/int", inner)
    mart = {"dim_users": dim_users(facts["user_profiles"]),
            "fct_daily_user_snapshot": fct_daily_user_snapshot(*[facts[name] for name in inner[1:]])}
    write_layer(mart, f"{root}/mart", daily, {"fct_daily_user_snapshot": [USER]})
    written = read_layer(spark, f"{root}/mart", list(mart))
    intervals = subscription_intervals(raw, as_of, stop_at_cancel)
    matrix = assemble_matrix(written["dim_users"], behaviour_from_facts(intervals, *[facts[name] for name in inner[2:]], as_of))
    write_layer({"churn_feature_matrix": matrix}, f"{root}/analytics")
    return {**facts, **written, **read_layer(spark, f"{root}/analytics", ["churn_feature_matrix"])}


BUCKETED = ("dim_users", "subscription_lifecycle_daily", "user_activity_daily", "customer_support_daily", "billing_and_revenue_daily")


def write_bucketed_warehouse(raw: Mapping[str, DataFrame], as_of: dt.date, database: str, buckets: int = 256) -> dict[str, DataFrame]:
    """The layers as catalog tables in equal buckets by user, so that no later layer moves a row to join or roll up.

    Each table is shuffled once, when it is written. Bills get their user then; the snapshot and the matrix are bucket by
    bucket joins and aggregations of what lies there. A bucket holds whole users, whose rows the calendar bounds.
    """
    spark = next(iter(raw.values())).sparkSession
    create_database(spark, database)
    lazy = build_all(raw, as_of)
    owners = raw["subscription_accounts"].select(SUBSCRIPTION, USER)
    lazy["billing_and_revenue_daily"] = lazy["billing_and_revenue_daily"].join(owners, SUBSCRIPTION)
    for name in BUCKETED:
        create_table_as(lazy[name], f"{database}.{name}", bucket_by=(buckets, [USER]))
    tables = {name: spark.table(f"{database}.{name}") for name in BUCKETED}
    snapshot = fct_daily_user_snapshot(*[tables[name] for name in BUCKETED[1:]])
    create_table_as(snapshot, f"{database}.fct_daily_user_snapshot", bucket_by=(buckets, [USER]))
    tables["fct_daily_user_snapshot"] = spark.table(f"{database}.fct_daily_user_snapshot")
    matrix = churn_feature_matrix(tables["fct_daily_user_snapshot"], tables["dim_users"])
    create_table_as(matrix, f"{database}.churn_feature_matrix", bucket_by=(buckets, [USER]))
    return {**tables, "churn_feature_matrix": spark.table(f"{database}.churn_feature_matrix")}
