"""Table maintenance: queries that write to the application's shared folder and read back what was committed."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidemark.catalogue.base import query, table
from tidemark.catalogue.models import APPROVED_SQL, AT, RUN, UPSERT_SQL, USER, held_predictions, prediction_batch, reviewed
from tidemark.plans.dispatch import audit_rows
from tidemark.session import shared_folder
from tidemark.sources import keyed, readers, signatures, sinks


def folder(spark) -> str:
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


EDITS_SQL = """edits AS (SELECT CAST(o_custkey AS VARCHAR) AS user_account_id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS note
  FROM orders GROUP BY o_custkey),
merged AS (SELECT coalesce(b.user_account_id, n.user_account_id) AS user_account_id, CASE WHEN n.user_account_id IS NULL THEN b.industry_type ELSE n.industry_type END AS industry_type,
  CASE WHEN n.user_account_id IS NULL THEN b.projected_ltv ELSE n.projected_ltv END AS projected_ltv, coalesce(prediction_timestamp, TIMESTAMP '2024-02-01') AS prediction_timestamp, audit_action_status
  FROM base b FULL JOIN batch n ON b.user_account_id = n.user_account_id)"""


@query("s8_bucket_commits", f"""
WITH {UPSERT_SQL}, {EDITS_SQL}
SELECT m.user_account_id, industry_type, projected_ltv, prediction_timestamp, CASE WHEN e.user_account_id IS NULL THEN audit_action_status ELSE status END AS audit_action_status,
       note AS audit_notes FROM merged m LEFT JOIN edits e ON m.user_account_id = e.user_account_id""")
def bucket_commits(spark, sf):
    """A keyed table in four commits: rows, an upsert, a compaction of the buckets that it touched, an update on top."""
    path = folder(spark)
    keyed.create(held_predictions(spark, sf), path, "user_account_id", 16)
    loaded_at = F.lit(dt.datetime(2024, 2, 1))
    keyed.commit_upsert(prediction_batch(spark, sf), path, ["industry_type", "projected_ltv"], loaded_at, "prediction_timestamp")
    keyed.compact(spark, path)
    edits = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("user_account_id"), "o_orderkey",
                                              F.col("o_orderstatus").alias("audit_action_status"), F.col("o_orderpriority").alias("audit_notes"))
    keyed.commit_update(edits, path, ["audit_action_status", "audit_notes"], "o_orderkey")
    return keyed.read(spark, path).select("user_account_id", "industry_type", "projected_ltv", "prediction_timestamp", "audit_action_status", "audit_notes")


@query("s11_log_runs", f"""
WITH {APPROVED_SQL}
SELECT run, substr(sha256(run || '|' || event_type || '|' || user_account_id), 1, 32) AS audit_id, user_account_id, tier AS allocated_operational_tier, action_taken,
       TIMESTAMP '{AT}' + INTERVAL (day) DAY AS event_timestamp FROM approved, (VALUES ('{RUN}', 0), ('{RUN}-b', 1)) AS runs(run, day)""")
def log_runs(spark, sf):
    """Two runs of a dispatch logged, the first one twice: its retry adds nothing."""
    path, rows = folder(spark), reviewed(spark, sf)
    for run, day in ((RUN, 0), (f"{RUN}-b", 1), (RUN, 0)):
        logged = audit_rows(rows, run, USER, AT + dt.timedelta(days=day), "outbox", "{}")
        sinks.append_audit_log(logged, path, run)
    log = sinks.read_audit_log(spark, path)
    first = F.col("event_timestamp") == F.lit(AT).cast("timestamp_ntz")
    return log.select(F.when(first, RUN).otherwise(f"{RUN}-b").alias("run"), "audit_id", "user_account_id", "allocated_operational_tier", "action_taken", "event_timestamp")


@query("s3_layer_round_trip", """
SELECT 'orders' AS name, CAST(o_orderdate AS DATE) AS activity_date, o_orderkey AS id, o_orderstatus AS label FROM orders
UNION ALL SELECT 'customer', NULL, c_custkey, c_mktsegment FROM customer
UNION ALL SELECT 'csv', NULL, n_nationkey, n_name FROM nation""")
def layer_round_trip(spark, sf):
    """A layer overwritten twice, one of its tables emptied, a partitioned and sorted table and a CSV copy read back."""
    path = folder(spark)
    orders = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("activity_date"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    layer = {"orders": orders.withColumn("activity_month", F.trunc("activity_date", "year")), "customer": customers, "gone": customers}
    for _ in range(2):
        sinks.write_layer(layer, path, {"orders": ["activity_month"]}, {"orders": ["id"]})
    sinks.truncate_layer(spark, path, ["gone"])
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"))
    sinks.write_csv({"nation": nations}, path)
    held = readers.read_layer(spark, path, ["orders", "customer", "gone"])
    csv = readers.read_csv(spark, f"{path}/nation.csv", nations.schema)
    parts = [("orders", held["orders"]), ("customer", held["customer"]), ("customer", held["gone"]), ("csv", csv)]
    out = None
    for name, df in parts:
        day = F.col("activity_date") if "activity_date" in df.columns else F.lit(None).cast("date")
        part = df.select(F.lit(name).alias("name"), day.alias("activity_date"), "id", "label")
        out = part if out is None else out.unionByName(part)
    return out


@query("f10_indexed_search", """
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE CAST(c_custkey AS VARCHAR) ILIKE '%123%' OR c_name ILIKE '%123%' OR c_mktsegment ILIKE '%123%'""")
def indexed_search(spark, sf):
    """The customers written in order of their key, their files' signatures, and a search that opens the files that can match."""
    path = folder(spark)
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    customers.repartitionByRange(8, "c_custkey").write.parquet(f"{path}/customer")
    signatures.write_signatures(spark, f"{path}/customer", f"{path}/customer_index")
    return signatures.search_indexed(spark, f"{path}/customer", f"{path}/customer_index", "123")
