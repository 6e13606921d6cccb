"""Column layouts of the raw, prediction and audit tables: column names with their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
}

# Raw tables in file order.
RAW_LAYOUTS = {
    "app_user_accounts": (
        "user_account_id bigint, external_user_uuid string, email_address string, email_normalized string, email_verified_at timestamp_ntz, "
        "password_hash string, password_algorithm string, account_status_enum string, registration_source string, locale_code string, "
        "timezone_name string, marketing_opt_in_flag boolean, gdpr_consent_version string, last_successful_login_at timestamp_ntz, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, row_version_id int, is_deleted boolean"),
    "app_user_profiles": (
        "profile_id bigint, user_account_id bigint, first_name string, last_name string, display_name string, company_name string, "
        "job_title string, industry_code string, employee_count_range string, annual_revenue_range string, phone_number string, "
        "country_code string, profile_attributes_json string, created_at timestamp_ntz, updated_at timestamp_ntz"),
    "user_master_profiles": (
        "user_account_id bigint, country_code string, city string, region string, currency_code string, tax_rate double, activity_tier "
        "string, registration_source string, carrier_provider string, account_end_at timestamp_ntz"),
    "user_device_profiles": (
        "user_account_id bigint, device_rank int, device_id string, platform_type string, operating_system string, device_model string, "
        "browser_name string, browser_version string, user_agent_string string, country_code string, geo_city string"),
    "subscription_accounts": (
        "subscription_id bigint, user_account_id bigint, external_billing_customer_id string, subscription_plan_code string, "
        "subscription_status string, billing_cycle string, trial_started_at timestamp_ntz, trial_ends_at timestamp_ntz, "
        "subscription_started_at timestamp_ntz, subscription_ended_at timestamp_ntz, auto_renew_enabled boolean, cancellation_requested_at "
        "timestamp_ntz, cancellation_reason_code string, cancellation_comment string, created_at timestamp_ntz, updated_at timestamp_ntz"),
    "subscription_state_history": (
        "subscription_state_id bigint, subscription_id bigint, previous_state string, new_state string, transition_trigger string, "
        "actor_user_id bigint, raw_transition_payload string, effective_at timestamp_ntz, created_at timestamp_ntz"),
    "auth_login_events": (
        "login_event_id bigint, user_account_id bigint, login_method string, authentication_result string, client_ip_address string, "
        "user_agent_string string, device_fingerprint_hash string, geo_country string, geo_city string, failure_reason_code string, "
        "risk_score_raw double, created_at timestamp_ntz"),
    "auth_session_tokens": (
        "session_id string, user_account_id bigint, access_token_hash string, refresh_token_hash string, device_id string, "
        "client_ip_address string, user_agent_string string, session_started_at timestamp_ntz, session_expires_at timestamp_ntz, "
        "session_terminated_at timestamp_ntz, termination_reason string, created_at timestamp_ntz"),
    "product_sessions": (
        "product_session_id string, user_account_id bigint, anonymous_device_id string, platform_type string, app_version string, "
        "operating_system string, device_model string, browser_name string, browser_version string, session_started_at timestamp_ntz, "
        "session_ended_at timestamp_ntz, termination_reason string, created_at timestamp_ntz"),
    "frontend_performance_events": (
        "performance_event_id bigint, product_session_id string, page_route string, first_contentful_paint_ms int, "
        "largest_contentful_paint_ms int, cumulative_layout_shift double, time_to_interactive_ms int, dom_load_time_ms int, "
        "api_wait_time_ms int, render_time_ms int, network_type string, captured_at timestamp_ntz"),
    "clickstream_events": (
        "event_id bigint, product_session_id string, event_uuid string, event_name string, event_category string, page_screen_name string, "
        "ui_component_name string, interaction_type string, event_timestamp timestamp_ntz, ingestion_timestamp timestamp_ntz, "
        "event_sequence_number int, latency_ms int, client_ip_address string, geo_country string, geo_city string, sdk_version string, "
        "event_payload_json string, created_at timestamp_ntz"),
    "application_error_logs": (
        "error_log_id bigint, service_name string, service_version string, environment_name string, trace_id string, span_id string, "
        "exception_class string, error_message string, stack_trace string, http_status_code int, endpoint_path string, raw_error_payload "
        "string, occurred_at timestamp_ntz"),
    "mobile_application_events": (
        "mobile_event_id bigint, user_account_id bigint, application_event string, occurred_at timestamp_ntz, device_id string, app_version "
        "string, os_version string, push_token string, event_payload string"),
    "feature_flag_exposures": (
        "exposure_id bigint, user_account_id bigint, feature_flag_key string, variant_key string, evaluation_reason string, "
        "rule_set_version string, exposure_context_json string, exposed_at timestamp_ntz"),
    "experiment_assignments": (
        "assignment_id bigint, user_account_id bigint, experiment_key string, treatment_group string, assignment_hash string, "
        "allocation_algorithm string, assigned_at timestamp_ntz"),
    "notification_delivery_events": (
        "notification_event_id bigint, user_account_id bigint, notification_channel string, template_id string, provider_name string, "
        "provider_message_id string, delivery_status string, provider_response string, created_at timestamp_ntz"),
    "support_tickets": (
        "ticket_id bigint, user_account_id bigint, external_ticket_id string, ticket_status string, ticket_priority string, category_code "
        "string, subcategory_code string, subject string, description string, assigned_agent_id int, first_response_at timestamp_ntz, "
        "resolved_at timestamp_ntz, created_at timestamp_ntz"),
    "support_ticket_events": (
        "ticket_event_id bigint, ticket_id bigint, event_type string, actor_type string, actor_id int, event_payload string, created_at "
        "timestamp_ntz"),
    "user_feedback_submissions": (
        "feedback_id bigint, user_account_id bigint, feedback_type string, rating_value int, free_text_feedback string, source_screen "
        "string, session_id string, metadata_json string, submitted_at timestamp_ntz"),
    "billing_invoices": (
        "invoice_id bigint, subscription_id bigint, external_invoice_id string, invoice_status string, currency_code string, "
        "subtotal_amount double, tax_amount double, discount_amount double, total_amount double, due_date timestamp_ntz, paid_at "
        "timestamp_ntz, created_at timestamp_ntz"),
    "payment_transactions": (
        "payment_transaction_id bigint, invoice_id bigint, external_payment_id string, payment_provider string, payment_method_type string, "
        "transaction_status string, failure_code string, failure_message string, processor_response_code string, amount double, "
        "currency_code string, provider_response_payload string, initiated_at timestamp_ntz, completed_at timestamp_ntz"),
}

# Declared tables.
PREDICTION_LAYOUT = (
    "user_account_id string, country string, industry_type string, registration_plan_code string, customer_tenure_days int, "
    "is_churned_historical int, calibrated_churn_probability double, monthly_arpu double, projected_ltv double, currency string, "
    "allocated_operational_tier string, primary_frustration_driver_vector string, prediction_timestamp timestamp_ntz")
AUDIT_COLUMNS_LAYOUT = (
    "audit_action_status string, audit_notes string, audit_override_by string, audit_override_at timestamp_ntz")
AUDIT_LOG_LAYOUT = (
    "audit_id string, user_account_id string, allocated_operational_tier string, action_status string, action_taken string, "
    "action_notes string, triggered_by string, request_id string, automation_target string, automation_response string, status string, "
    "event_timestamp timestamp_ntz, created_at timestamp_ntz")
AUDIT_LOG_REQUIRED = ("audit_id", "user_account_id", "action_taken", "status", "event_timestamp")


def layout_schema(layout: str) -> T.StructType:
    fields = [pair.split(" ") for pair in layout.split(", ")]
    return T.StructType([T.StructField(name, TYPES[kind], True) for name, kind in fields])


RAW_SCHEMAS = {name: layout_schema(layout) for name, layout in RAW_LAYOUTS.items()}
PREDICTIONS = layout_schema(PREDICTION_LAYOUT)
AUDIT_COLUMNS = layout_schema(AUDIT_COLUMNS_LAYOUT)
AUDIT_LOG = layout_schema(AUDIT_LOG_LAYOUT)
