"""The eight derived tables over the stand-in raw tables, with SQL twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalogue.base import query, sql_round as r
from tidemark.catalogue.standin import AS_OF, RAW_SQL, raw_tables
from tidemark.functions import half_up
from tidemark.plans import incremental
from tidemark.plans import warehouse as wh


# The columns that the twins give, stated apart from the tables' own lists.
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


def round_doubles(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded half up. Most days are quiet: their zeros need no exact decimal, which is the dear part of a wide table."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.when(F.col(name) == 0, F.lit(0.0)).otherwise(half_up(name, places)) for name in doubles})


def _json(column: str, field: str, pattern: str, replacement: str) -> str:
    keys = r"""regexp_replace(%s, '([a-zA-Z0-9_]+)\s*:', '"\1":', 'g')""" % column
    fixed = f"regexp_replace({keys}, '{pattern}', '{replacement}', 'g')"
    return f"CASE WHEN json_valid({column}) THEN json_extract_string({column}, '$.{field}') ELSE json_extract_string({fixed}, '$.{field}') END"


def _word(column: str, field: str) -> str:
    return _json(column, field, r":\s*([a-zA-Z0-9_]+)", r': "\1"')


def _phrase(column: str, field: str) -> str:
    return _json(column, field, r':\s*([^"}]+)\s*([,}])', r': "\1"\2')


def _n(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


def _listed(column: str) -> str:
    return f"string_agg(DISTINCT {column}, ', ' ORDER BY {column})"


def _seconds(start: str, end: str) -> str:
    return f"date_diff('microsecond', {start}, {end})"


BY_USER = {
    "log_in": ("auth_login_events", {
        "total_logins": "count(login_event_id)", "successful_logins": _n("authentication_result = 'SUCCESS'"),
        "failed_logins": _n("authentication_result = 'FAILURE'"), "avg_authentication_risk_score": r("avg(risk_score_raw)", 3)}),
    "token": ("auth_session_tokens", {
        "total_auth_sessions": "count(session_id)",
        "avg_auth_session_duration_sec": r(f"avg({_seconds('session_started_at', 'session_terminated_at')}) / 1e6", 2)}),
    "trial": ("experiment_assignments", {"total_assigned_experiments": "count(assignment_id)"}),
    "shown": ("feature_flag_exposures", {
        "user_tier": f"max({_word('exposure_context_json', 'user_tier')})",
        "pdf_generation_variant": "max(variant_key) FILTER (WHERE feature_flag_key = 'pdf-generation-v2')",
        "advance_search_elastic_variant": "max(variant_key) FILTER (WHERE feature_flag_key = 'advanced-search-elastic')"}),
    "mobile": ("mobile_application_events", {"network_carrier": f"max({_phrase('event_payload', 'network_carrier')})"}),
    "visit": ("product_sessions", {"device_count": "count(DISTINCT anonymous_device_id)", "device_models": _listed("device_model")}),
    "ticket": ("support_tickets", {"total_tickets": "count(ticket_id)", "open_tickets": _n("ticket_status = 'OPEN'"), "closed_tickets": _n("ticket_status = 'CLOSED'")}),
    "opinion": ("user_feedback_submissions", {"total_feedbacks": "count(feedback_id)", "avg_rating": r("avg(rating_value)", 2)}),
}
ACCOUNT_SQL = {
    "external_user_uuid": "external_user_uuid", "email": "email_normalized", "locale_code": "locale_code", "timezone": "timezone_name",
    "email_verification_flag": "(email_verified_at IS NOT NULL)::INTEGER", "account_status": "account_status_enum",
    "registration_source": "registration_source", "marketing_opt_in_flag": "coalesce(marketing_opt_in_flag, false)::INTEGER",
    "account_creation_date": "created_at::DATE", "account_update_date": "updated_at::DATE",
    "last_successful_login_at": "last_successful_login_at::DATE", "account_deletion_date": "deleted_at::DATE",
    "account_deletion_flag": "coalesce(is_deleted, false)::INTEGER"}
PERSON_SQL = {
    "user_name": "display_name", "phone_number": "phone_number", "country": "country_code", "company_name": "company_name", "job_title": "job_title",
    "industry_type": "industry_code", "employee_count_range": "employee_count_range", "annual_revenue_range": "annual_revenue_range",
    "profile_theme": _word("profile_attributes_json", "theme"),
    "onboarding_completed_flag": f"coalesce(({_word('profile_attributes_json', 'onboarding_completed')}) = 'true', false)::INTEGER"}
PLAN_SQL = {
    "subscription_id": "subscription_id", "subscription_plan_code": "subscription_plan_code", "subscription_status": "subscription_status",
    "billing_cycle": "billing_cycle", "auto_renew_flag": "coalesce(auto_renew_enabled, false)::INTEGER", "trial_start_date": "trial_started_at::DATE",
    "trial_end_date": "trial_ends_at::DATE", "subscription_start_date": "subscription_started_at::DATE", "subscription_end_date": "subscription_ended_at::DATE",
    "cancellation_request_date": "cancellation_requested_at::DATE", "cancellation_reason_code": "cancellation_reason_code", "cancellation_comment": "cancellation_comment"}


def _projection(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


def _profile_column(name: str) -> str:
    default = wh.PROFILE_DEFAULTS.get(name)
    if default is None:
        return name
    return f"coalesce({name}, {default!r}) AS {name}"


PROFILE_CTES = ",\n".join([
    *[f"{alias} AS (SELECT user_account_id, {_projection(columns)} FROM {source} GROUP BY user_account_id)" for alias, (source, columns) in BY_USER.items()],
    f"person AS (SELECT user_account_id, {_projection(PERSON_SQL)} FROM app_user_profiles)",
    f"plan AS (SELECT user_account_id, {_projection(PLAN_SQL)} FROM subscription_accounts)",
    "money AS (SELECT user_account_id, currency_code AS currency FROM user_master_profiles)",
    f"account AS (SELECT user_account_id, {_projection(ACCOUNT_SQL)} FROM app_user_accounts)",
    "profiles AS (SELECT " + ", ".join(_profile_column(c) for c in PROFILE_COLUMNS) + " FROM account "
    + " ".join(f"LEFT JOIN {alias} USING (user_account_id)" for alias in ("person", "plan", "money", *BY_USER)) + ")",
])

LIFECYCLE_CTES = f"""
spans AS (SELECT h.subscription_id, a.user_account_id, a.subscription_plan_code, a.billing_cycle, new_state AS subscription_status, effective_at::DATE AS valid_from,
  coalesce(lead(effective_at::DATE) OVER (PARTITION BY h.subscription_id ORDER BY effective_at, subscription_state_id) - 1, DATE '{AS_OF}') AS valid_to
  FROM subscription_state_history h JOIN subscription_accounts a ON a.subscription_id = h.subscription_id),
lifecycle AS (SELECT subscription_id, user_account_id, unnest(generate_series(valid_from, least(valid_to, DATE '{AS_OF}'), INTERVAL 1 DAY))::DATE AS activity_date,
  subscription_plan_code, billing_cycle, subscription_status FROM spans WHERE valid_from <= least(valid_to, DATE '{AS_OF}'))"""

_AGENT = "CASE WHEN user_agent_string LIKE '%Android%' THEN {a} WHEN user_agent_string LIKE '%iPhone%' THEN {b} WHEN user_agent_string LIKE '%Windows%' THEN {c} ELSE {d} END"
_HASH = dict.fromkeys("abc", "device_fingerprint_hash")
_COUNTS = ["total_events", *wh.CLICK_COLUMNS.values(), *wh.SCREEN_COLUMNS.values()]
CLICK_SQL = {
    "total_events": "count(event_id)",
    **{name: _n(f"event_name = '{event}'") for event, name in wh.CLICK_COLUMNS.items()},
    **{name: _n(f"page_screen_name = '{screen}'") for screen, name in wh.SCREEN_COLUMNS.items()},
    "session_latency": r("avg(latency_ms)", 0), "cities": _listed("geo_city")}
PRODUCT_SQL = {
    "total_duration_sec": f"sum({_seconds('session_started_at', 'session_ended_at')} / 1e6)", "total_devices_used": "count(DISTINCT device_model)",
    "device_models": _listed("device_model"), "browsers_used": _listed("browser_name"), "platform_types": _listed("platform_type"), "geo_city": "max(cities)",
    **{name: f"CAST(sum({name}) AS BIGINT)" for name in _COUNTS}, "avg_latency": r("avg(session_latency)", 0),
    **{name: r(f"{'max' if measure is F.max else 'avg'}({source})", places) for name, (source, measure, places) in wh.SPEED_COLUMNS.items()}}
LOGIN_SQL = {
    "total_login_attempts": "count(login_event_id)", "successful_logins_count": _n("authentication_result = 'SUCCESS'"),
    "failed_logins_count": _n("authentication_result = 'FAILURE'"), "login_city": "max(geo_city)",
    "login_devices": _listed(_AGENT.format(**_HASH, d="'UNKNOWN_DEVICE'")), "login_browsers": _listed(_AGENT.format(**_HASH, d="'UNKNOWN_BROWSER'")),
    "login_platforms": _listed(_AGENT.format(a="'Android'", b="'IOS'", c="'WEB'", d="'UNKNOWN_PLATFORM'"))}
_TRAITS = {
    "device_models": "coalesce(device_models, (SELECT u.device_model FROM user_device_profiles u WHERE u.device_id = login_devices))",
    "browsers_used": "coalesce(browsers_used, (SELECT u.browser_name FROM user_device_profiles u WHERE u.device_id = login_browsers))",
    "platform_types": "coalesce(platform_types, login_platforms)", "geo_city": "coalesce(geo_city, login_city)"}


def _zeros(names: list[str]) -> str:
    return ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)


ACTIVITY_CTES = f"""
clicks AS (SELECT product_session_id, {_projection(CLICK_SQL)} FROM clickstream_events GROUP BY product_session_id),
product AS (SELECT user_account_id, product_sessions.created_at::DATE AS activity_date, {_projection(PRODUCT_SQL)}
  FROM product_sessions JOIN frontend_performance_events USING (product_session_id) JOIN clicks USING (product_session_id) GROUP BY ALL),
logged AS (SELECT user_account_id, created_at::DATE AS activity_date, {_projection(LOGIN_SQL)} FROM auth_login_events GROUP BY user_account_id, created_at::DATE),
opened AS (SELECT user_account_id, session_started_at::DATE AS activity_date, count(session_id) AS sessions_created_count, {_n("termination_reason = 'USER_LOGOUT'")} AS manual_logouts_count
  FROM auth_session_tokens GROUP BY user_account_id, session_started_at::DATE),
activity AS (SELECT user_account_id, activity_date, {_zeros(wh.ACTIVITY_MEASURES)}, {_projection(_TRAITS)}, {_zeros(wh.ACTIVITY_TELEMETRY)}
  FROM product FULL JOIN logged USING (user_account_id, activity_date) FULL JOIN opened USING (user_account_id, activity_date))"""

SUPPORT_CTES = f"""
raised AS (SELECT user_account_id, created_at::DATE AS activity_date, count(ticket_id) AS tickets_opened_today, {_n("ticket_priority = 'HIGH'")} AS high_priority_tickets_today,
  {_n("ticket_status = 'OPEN'")} AS active_open_tickets_today FROM support_tickets GROUP BY user_account_id, created_at::DATE),
worked AS (SELECT t.user_account_id, e.created_at::DATE AS activity_date, count(*) AS total_ticket_events_today, {_n("event_type = 'AGENT_COMMENT'")} AS agent_replies_today,
  {_n("event_type = 'ESCALATION'")} AS ticket_escalations_today FROM support_ticket_events e JOIN support_tickets t ON t.ticket_id = e.ticket_id GROUP BY t.user_account_id, e.created_at::DATE),
support AS (SELECT user_account_id, activity_date, {_zeros(wh.SUPPORT_MEASURES)} FROM raised FULL JOIN worked USING (user_account_id, activity_date))"""

BILLING_CTES = f"""
billed AS (SELECT subscription_id, created_at::DATE AS activity_date, count(invoice_id) AS total_invoices_generated_today, sum(total_amount) AS total_amount_invoiced_today,
  sum(tax_amount) AS total_tax_invoiced_today, max(currency_code) AS currency, {_n("invoice_status = 'FAILED'")} AS failed_invoices_today FROM billing_invoices GROUP BY subscription_id, created_at::DATE),
paid AS (SELECT i.subscription_id, p.initiated_at::DATE AS activity_date, coalesce(sum(amount) FILTER (WHERE transaction_status = 'SUCCESS'), 0) AS total_successful_payments_today,
  CAST(max((transaction_status = 'FAILED')::INTEGER) AS INTEGER) AS has_payment_failure_today_flag, {_listed('payment_method_type')} AS payment_methods_used_today,
  {_listed('failure_code')} AS payment_failure_codes_today FROM payment_transactions p JOIN billing_invoices i ON i.invoice_id = p.invoice_id GROUP BY i.subscription_id, p.initiated_at::DATE),
billing AS (SELECT subscription_id, activity_date, {', '.join(f'coalesce({n}, {d!r}) AS {n}' for n, d in wh.BILLING_DEFAULTS.items())} FROM billed FULL JOIN paid USING (subscription_id, activity_date))"""

_DIM = DIM_COLUMNS
DIM_CTE = "dim AS (SELECT " + ", ".join({"subscription_id": "coalesce(subscription_id, 0) AS subscription_id", "auto_renew_flag": "coalesce(auto_renew_flag, -1) AS auto_renew_flag"}.get(c, c) for c in _DIM) + " FROM profiles)"
_FACTS = {**wh.SNAPSHOT_ACTIVITY, **wh.SNAPSHOT_SUPPORT, **wh.SNAPSHOT_BILLING}
SNAPSHOT_CTE = f"""snap AS (SELECT activity_date, user_account_id, subscription_id, subscription_status AS historical_subscription_status,
  subscription_plan_code AS historical_subscription_plan_code, billing_cycle AS historical_billing_cycle,
  {', '.join(f'coalesce({fact}, {default!r}) AS {name}' for name, (fact, default) in _FACTS.items())}
  FROM lifecycle LEFT JOIN activity USING (user_account_id, activity_date) LEFT JOIN support USING (user_account_id, activity_date) LEFT JOIN billing USING (subscription_id, activity_date))"""
BASE = f"WITH {RAW_SQL}"
SNAPSHOT_ALL = ",\n".join([BASE, LIFECYCLE_CTES, ACTIVITY_CTES, SUPPORT_CTES, BILLING_CTES, SNAPSHOT_CTE])

_WINDOW = "activity_date >= last_day - {}"
_BEHAVIOUR = {
    "lifetime_total_active_days_observed": "count(DISTINCT activity_date)", "lifetime_avg_daily_active_minutes": "avg(daily_total_duration_sec) / 60.0",
    **{name: f"CAST(sum({c}) AS {'DOUBLE' if 'revenue' in name else 'BIGINT'})" for name, c in wh.LIFETIME_SUMS.items()},
    **{name: f"avg({c})" for name, c in wh.LIFETIME_MEANS.items()}, "lifetime_largest_contentful_paint_ms": "max(daily_largest_contentful_paint_ms)",
    "trailing_7d_avg_active_minutes": f"avg(daily_total_duration_sec) FILTER (WHERE {_WINDOW.format(7)}) / 60.0",
    "trailing_30d_avg_latency_ms": f"avg(daily_avg_latency_ms) FILTER (WHERE {_WINDOW.format(30)})",
    **{name: f"CAST(coalesce(sum({c}) FILTER (WHERE {_WINDOW.format(days)}), 0) AS BIGINT)" for name, (days, c) in wh.TRAILING_SUMS.items()}}
_DERIVED = {
    "customer_tenure_days": "CAST(last_day - account_creation_date AS INTEGER)", "currency": "coalesce(currency, 'UNKNOWN')",
    "active_minutes_drop_ratio_7d": r("CASE WHEN coalesce(lifetime_avg_daily_active_minutes, 0) = 0 THEN 0.0 ELSE coalesce(trailing_7d_avg_active_minutes, 0.0) / lifetime_avg_daily_active_minutes END"),
    "login_frequency_drop_ratio_7d": r("CASE WHEN lifetime_total_successful_logins = 0 THEN 0.0 ELSE (trailing_7d_total_logins / 7.0) / (lifetime_total_successful_logins::DOUBLE / lifetime_total_active_days_observed) END"),
    **{name: source for name, source in wh.MATRIX_ATTRIBUTES.items()}}
_REAL = {"lifetime_avg_daily_active_minutes", "lifetime_total_revenue_contributed", "lifetime_largest_contentful_paint_ms", "trailing_7d_avg_active_minutes",
         "trailing_30d_avg_latency_ms", *wh.LIFETIME_MEANS}


def _matrix_column(name: str) -> str:
    if name in _DERIVED:
        return f"{_DERIVED[name]} AS {name}"
    return f"{r(f'coalesce({name}, 0.0)')} AS {name}" if name in _REAL else name


MATRIX_CTES = f"""
ends AS (SELECT user_account_id, max(activity_date) AS last_day, CAST(max((historical_subscription_status = 'CANCELLED')::INTEGER) AS INTEGER) AS is_churned FROM snap GROUP BY user_account_id),
behaviour AS (SELECT user_account_id, {_projection(_BEHAVIOUR)} FROM snap JOIN ends USING (user_account_id) GROUP BY user_account_id),
matrix AS (SELECT {', '.join(_matrix_column(c) for c in MATRIX_COLUMNS)} FROM dim JOIN ends USING (user_account_id) JOIN behaviour USING (user_account_id))"""
MATRIX_ALL = ",\n".join([SNAPSHOT_ALL, PROFILE_CTES, DIM_CTE, MATRIX_CTES])


@query("j1_user_profiles", f"{BASE},\n{PROFILE_CTES}\nSELECT * FROM profiles")
def user_profiles(spark, sf):
    return wh.user_profiles(raw_tables(spark, sf))


@query("j5_subscription_lifecycle_daily", f"{BASE},\n{LIFECYCLE_CTES}\nSELECT * FROM lifecycle")
def subscription_lifecycle_daily(spark, sf):
    return wh.subscription_lifecycle_daily(raw_tables(spark, sf), AS_OF)


@query("j7_user_activity_daily", f"{BASE},\n{ACTIVITY_CTES}\nSELECT * REPLACE ({r('total_duration_sec')} AS total_duration_sec) FROM activity")
def user_activity_daily(spark, sf):
    return round_doubles(wh.user_activity_daily(raw_tables(spark, sf)))


@query("j6_customer_support_daily", f"{BASE},\n{SUPPORT_CTES}\nSELECT * FROM support")
def customer_support_daily(spark, sf):
    return wh.customer_support_daily(raw_tables(spark, sf))


_MONEY = ["total_amount_invoiced_today", "total_tax_invoiced_today", "total_successful_payments_today"]


@query("j6_billing_and_revenue_daily", f"{BASE},\n{BILLING_CTES}\nSELECT * REPLACE ({', '.join(f'{r(c)} AS {c}' for c in _MONEY)}) FROM billing")
def billing_and_revenue_daily(spark, sf):
    return round_doubles(wh.billing_and_revenue_daily(raw_tables(spark, sf)))


@query("f7_dim_users", f"{BASE},\n{PROFILE_CTES},\n{DIM_CTE}\nSELECT * FROM dim")
def dim_users(spark, sf):
    return wh.dim_users(wh.user_profiles(raw_tables(spark, sf)))


_SNAPSHOT_REAL = ["daily_total_duration_sec", "daily_amount_invoiced", "daily_tax_invoiced", "daily_successful_payments_collected"]


@query("j8_fct_daily_user_snapshot", f"{SNAPSHOT_ALL}\nSELECT * REPLACE ({', '.join(f'{r(c)} AS {c}' for c in _SNAPSHOT_REAL)}) FROM snap")
def fct_daily_user_snapshot(spark, sf):
    raw = raw_tables(spark, sf)
    return round_doubles(wh.fct_daily_user_snapshot(
        wh.subscription_lifecycle_daily(raw, AS_OF), wh.user_activity_daily(raw), wh.customer_support_daily(raw), wh.billing_and_revenue_daily(raw)))


def feature_matrix(spark, sf) -> DataFrame:
    return wh.build_all(raw_tables(spark, sf), AS_OF)["churn_feature_matrix"]


@query("a14_churn_feature_matrix", f"{MATRIX_ALL}\nSELECT * FROM matrix")
def churn_feature_matrix(spark, sf):
    return round_doubles(feature_matrix(spark, sf))


@query("a13_incremental_matrix", f"{MATRIX_ALL}\nSELECT * FROM matrix")
def incremental_matrix(spark, sf):
    """The same matrix from mergeable states: all days but the last fifteen, then these."""
    raw = raw_tables(spark, sf)
    built = wh.build_all(raw, AS_OF)
    partitions = incremental.partitions_for(raw["subscription_accounts"].count())
    days = incremental.user_days(*[built[name] for name in incremental.DAILY_TABLES], partitions)
    cut = F.lit(AS_OF - dt.timedelta(days=15))
    state = incremental.merge(*[incremental.state_of(days.filter(part), partitions) for part in (F.col(wh.DAY) <= cut, F.col(wh.DAY) > cut)])
    return round_doubles(wh.assemble_matrix(built["dim_users"], incremental.measures(state)))
