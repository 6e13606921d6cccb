"""The recurring jobs: refresh predictions, record reviews, dispatch approved customers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import filters, mutation, quality
from tidemark.plans import dispatch, features, scoring, training
from tidemark.session import cut_lineage
from tidemark.sources import keyed
from tidemark.sources.schemas import AUDIT_COLUMNS, PREDICTIONS
from tidemark.sources.sinks import append_audit_log, write_outbox

KEEP = ("user_account_id", "country", "industry_type", "registration_plan_code", "customer_tenure_days", "is_churned",
        "currency", "total_revenue_contributed")
MAPPED = [f.name for f in PREDICTIONS.fields if f.name != "prediction_timestamp"]


#: A bucket with this many commits of changes is rewritten by the job that added the last one.
COMPACT_AFTER = 8


def refresh_predictions(matrix: DataFrame, bundle: training.Bundle, table: str, loaded_at: dt.datetime,
                        touch_timestamp: bool = False, buckets: int = keyed.BUCKETS) -> int:
    """Score a whole feature matrix and upsert it into the prediction table; returns the number of the commit.

    A matrix may repeat a user that has several subscriptions; the table holds the row of the
    riskiest one.
    """
    spark = matrix.sparkSession
    source = features.typed_matrix(quality.strip_token(matrix))
    frame = scoring.prediction_frame(training.score(source, bundle, KEEP))
    batch = mutation.latest_per_key(frame.withColumn("__order", F.struct(
        "calibrated_churn_probability", "projected_ltv", "registration_plan_code")), "user_account_id", "__order").drop("__order")
    if keyed.state_of(spark, table) is None:
        fields = [*PREDICTIONS.fields, *AUDIT_COLUMNS.fields]
        first = mutation.add_columns(batch.drop("prediction_timestamp"), fields)
        rows = first.select(*[(F.lit(loaded_at) if f.name == "prediction_timestamp" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in fields])
        return keyed.create(rows, table, "user_account_id", buckets)
    commit = keyed.commit_upsert(batch, table, MAPPED, F.lit(loaded_at), "prediction_timestamp", touch_timestamp)
    keyed.compact(spark, table, COMPACT_AFTER)
    return commit


def record_reviews(spark: SparkSession, edits: DataFrame, table: str, user: str, at: dt.datetime, order: str) -> dict[str, int]:
    """Apply reviewers' edits to the prediction table; an edit with an unknown status rejects the batch."""
    checked = cut_lineage(filters.stamp_edits(edits, user, at))
    if checked.isEmpty():
        return {"submitted": 0, "matched": 0}
    bad = quality.status_violations(checked).count()
    if bad:
        raise ValueError(f"{bad} edits carry a missing or unknown status")
    counts = keyed.commit_update(checked, table, [f.name for f in AUDIT_COLUMNS.fields], order)
    keyed.compact(spark, table, COMPACT_AFTER)
    return counts


def dispatch_approved(spark: SparkSession, table: str, outbox: str, log: str, run_id: str, user: str, at: dt.datetime,
                      notes: str = "") -> dict[str, int]:
    """Write the payloads of all approved customers to the outbox, then their audit rows to the log.

    Both steps can be repeated under one ``run_id`` without sending or logging anyone twice.
    """
    reviewed = filters.with_audit_columns(keyed.read(spark, table))
    payloads = cut_lineage(dispatch.dispatch_payloads(reviewed, run_id, user, at, notes))
    count = payloads.count()
    if count:
        write_outbox(payloads, outbox, run_id)
    rows = append_audit_log(dispatch.audit_rows(reviewed, run_id, user, at, outbox, "{}", notes).withColumn(
        "created_at", F.lit(at)), log, run_id)
    return {"payloads": count, "customers": rows}
