"""Dispatch payloads, audit log rows and message texts for approved customers.

A tier may hold a third of all customers, so no payload gathers a tier: a campaign is one envelope row and one line per
customer that carries the envelope's request id. The shape is the same for one customer and for all of them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hashed_id
from tidemark.operators.filters import only_approved
from tidemark.operators.ranking import numbered

KEY, TIER = "user_account_id", "allocated_operational_tier"


@dataclass(frozen=True)
class Campaign:
    tier: str
    event_type: str
    action: str
    fallback_status: str


# Fixed values.
CAMPAIGNS = (
    Campaign("VIP_RED_ALERT", "VIP_RED_DISPATCH", "SLACK_DISPATCH_TO_SALES", "ESCALATED_TO_SALES"),
    Campaign("AUTOMATED_LOW_COST_EMAIL", "AUTOMATED_EMAIL_DISPATCH", "AI_EMAIL_AUTOMATION_TRIGGERED", "EMAIL_AUTOMATION_QUEUED"),
)
TEAMS = ("CS", "SALES")
MESSAGES = {
    "VIP_RED_DISPATCH": ("VIP Customers at Churn Risk", "Here is the list of customer_id: \n{ids}\n\nHere are the audit notes:\n{notes}"),
    "AUTOMATED_EMAIL_DISPATCH": ("Send automated emails to these customers", "Send Automated emails to:\n{ids}\n"),
}


def json_safe(df: DataFrame) -> list[Column]:
    """Columns fit for JSON: NaN and infinities become NULL, times become ISO text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        columns.append(column.alias(field.name))
    return columns


def json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON text per row, NULLs written out."""
    return df.select(F.to_json(F.struct(*json_safe(df)), {"ignoreNullFields": "false"}).alias(name))


def unwrap_records(df: DataFrame, column: str, schema: T.StructType, field: str = "predictions") -> DataFrame:
    """A JSON document with a list of records to one row per record."""
    wrapper = T.StructType([T.StructField(field, T.ArrayType(schema))])
    return df.select(F.explode(F.from_json(column, wrapper)[field]).alias("r")).select("r.*")


def wrap_records(df: DataFrame, field: str = "rows") -> DataFrame:
    """The inverse: one document ``{field: [record]}`` per row, each readable by itself."""
    record = F.struct(F.array(F.struct(*json_safe(df))).alias(field))
    return df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("body"))


def joined_lines(df: DataFrame, by: str, key: str, note: str) -> DataFrame:
    """The entries of each group's joined list as rows: ``position`` from 0 in key order, id as text, missing notes empty."""
    rows = df.select(by, F.col(key).alias("__id"), F.coalesce(F.col(note), F.lit("")).alias("note"))
    return numbered(rows, [by], F.col("__id"), ["note"], "position").select(by, "position", F.col("__id").cast("string").alias("id"), "note")


def _campaign_rows(df: DataFrame) -> DataFrame:
    """Approved rows of the two campaign tiers with their campaign's values."""
    approved = only_approved(df).filter(F.col(TIER).isin([c.tier for c in CAMPAIGNS]))

    def pick(attribute: str) -> Column:
        first, second = CAMPAIGNS
        return F.when(F.col(TIER) == first.tier, getattr(first, attribute)).otherwise(getattr(second, attribute))

    return approved.withColumns({"event_type": pick("event_type"), "action_taken": pick("action"),
                                 "fallback_status": pick("fallback_status")})


def request_id(run_id: str) -> Column:
    """The same run gives the same ids, so a retried job cannot dispatch twice under two ids."""
    return hashed_id(F.lit(run_id), "event_type")


def dispatch_envelopes(df: DataFrame, run_id: str, user: str, at: dt.datetime, notes: str) -> DataFrame:
    """One JSON envelope per campaign with approved rows: event_type, customers, payload."""
    counted = _campaign_rows(df).groupBy("event_type").agg(F.count(F.lit(1)).alias("customers"))
    payload = F.to_json(F.struct(
        F.lit("envelope").alias("kind"), "event_type", request_id(run_id).alias("request_id"), F.lit(user).alias("triggered_by"),
        F.lit(at.isoformat()).alias("timestamp"), F.array(*[F.lit(t) for t in TEAMS]).alias("target_teams"),
        F.lit(notes).alias("notes"), "customers"), {"ignoreNullFields": "false"})
    return counted.select("event_type", "customers", payload.alias("payload"))


def dispatch_lines(df: DataFrame, run_id: str, at: dt.datetime) -> DataFrame:
    """One JSON line per approved customer with its record and log stub: event_type, user_account_id, payload."""
    log = F.struct(F.coalesce(F.col(KEY).cast("string"), F.lit("UNKNOWN")).alias("user_account_id"), "action_taken",
                   F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).alias("timestamp"), F.lit("PENDING").alias("status"))
    rows = _campaign_rows(df).withColumns({"__record": F.struct(*json_safe(df)), "__log": log})
    payload = F.to_json(F.struct(F.lit("customer").alias("kind"), "event_type", request_id(run_id).alias("request_id"),
                                 F.col("__record").alias("customer"), F.col("__log").alias("log")), {"ignoreNullFields": "false"})
    return rows.select("event_type", F.col(KEY).cast("string").alias("user_account_id"), payload.alias("payload"))


def dispatch_payloads(df: DataFrame, run_id: str, user: str, at: dt.datetime, notes: str) -> DataFrame:
    """Envelopes and customer lines together, as the outbox takes them; campaigns without approved rows give none."""
    return dispatch_envelopes(df, run_id, user, at, notes).select("event_type", "payload").unionByName(
        dispatch_lines(df, run_id, at).select("event_type", "payload"))


def audit_rows(df: DataFrame, run_id: str, user: str, at: dt.datetime, target: str, response: str, notes: str = "") -> DataFrame:
    """Log rows of a dispatched batch; the batch note overrides the row's own note."""
    rows = _campaign_rows(df)
    own_note = F.col("audit_notes") if "audit_notes" in df.columns else F.lit("")
    return rows.select(
        hashed_id(F.lit(run_id), "event_type", KEY).alias("audit_id"),
        F.coalesce(F.col(KEY).cast("string"), F.lit("UNKNOWN")).alias("user_account_id"),
        F.coalesce(TIER, F.lit("")).alias("allocated_operational_tier"),
        F.coalesce("audit_action_status", "fallback_status").alias("action_status"), "action_taken",
        F.coalesce(F.nullif(F.lit(notes), F.lit("")), own_note).alias("action_notes"), F.lit(user).alias("triggered_by"),
        request_id(run_id).alias("request_id"), F.lit(target).alias("automation_target"),
        F.lit(response).alias("automation_response"), F.lit("SUCCESS").alias("status"),
        F.lit(at).cast(T.TimestampNTZType()).alias("event_timestamp"))


def message_lines(df: DataFrame) -> DataFrame:
    """Subject, template and, in key order, the ids and notes that fill it: one row per approved customer.

    A sender writes the template once per campaign and the lines in the order of ``position``.
    """
    lines = joined_lines(_campaign_rows(df), "event_type", KEY, "audit_notes")
    (vip, (vip_subject, vip_body)), (_, (mail_subject, mail_body)) = MESSAGES.items()
    is_vip = F.col("event_type") == vip
    return lines.select("event_type", "position", "id", "note", F.when(is_vip, vip_subject).otherwise(mail_subject).alias("subject"),
                        F.when(is_vip, vip_body).otherwise(mail_body).alias("template"))
