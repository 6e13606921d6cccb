"""The recurring jobs end to end on the feature matrix of the smallest tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.catalogue.standin import AS_OF, raw_tables
from tidemark.operators.filters import recent
from tidemark.plans import jobs, training, warehouse
from tidemark.operators.quality import strip_token
from tidemark.sources import keyed
from tidemark.sources.sinks import read_audit_log

T = dt.datetime


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    return warehouse.write_warehouse(raw_tables(spark, "/root/testdata/sf0.001"), AS_OF, str(tmp_path_factory.mktemp("lake")))


def test_written_layers_equal_the_lazy_plan(spark, written):
    lazy = warehouse.build_all(raw_tables(spark, "/root/testdata/sf0.001"), AS_OF)
    for name in ("user_activity_daily", "fct_daily_user_snapshot", "churn_feature_matrix"):
        assert written[name].count() == lazy[name].count()
    day = written["fct_daily_user_snapshot"].filter(F.col("activity_date") == F.lit(dt.date(2024, 1, 10)))
    assert "PartitionFilters: [isnotnull(activity_date" in day._jdf.queryExecution().executedPlan().toString()


def test_score_review_dispatch(spark, written, tmp_path):
    table, outbox, log = (str(tmp_path / name) for name in ("predictions", "outbox", "log"))
    matrix = written["churn_feature_matrix"]
    bundle = training.train_bundle(strip_token(matrix), blueprints=training.model_blueprints(max_iter=3, depth=2))
    assert jobs.refresh_predictions(matrix, bundle, table, T(2024, 2, 1), buckets=8) == 1
    users = matrix.select("user_account_id").distinct().count()
    first = keyed.read(spark, table)
    assert first.count() == users == first.select("user_account_id").distinct().count()

    chosen = first.select("user_account_id").orderBy("user_account_id").limit(5)
    edits = chosen.withColumns({"audit_action_status": F.lit("APPROVED"), "audit_notes": F.lit("ok"), "audit_override_by": F.lit(""),
                                "audit_override_at": F.lit(None).cast("timestamp_ntz"), "no": F.lit(1)})
    unknown = edits.limit(1).withColumn("user_account_id", F.lit("nobody"))
    assert jobs.record_reviews(spark, edits.union(unknown), table, "me", T(2024, 2, 2), "no") == {"submitted": 6, "matched": 5}
    with pytest.raises(ValueError, match="status"):
        jobs.record_reviews(spark, edits.withColumn("audit_action_status", F.lit("MAYBE")), table, "me", T(2024, 2, 2), "no")
    assert jobs.record_reviews(spark, edits.limit(0), table, "me", T(2024, 2, 2), "no") == {"submitted": 0, "matched": 0}

    assert jobs.refresh_predictions(matrix, bundle, table, T(2024, 3, 1)) == 3
    again = keyed.read(spark, table)
    assert again.filter("audit_action_status = 'APPROVED' AND audit_override_by = 'me'").count() == 5
    assert again.filter(F.col("prediction_timestamp") == F.lit(T(2024, 2, 1))).count() == users

    tiers = ["VIP_RED_ALERT", "AUTOMATED_LOW_COST_EMAIL"]
    expected = again.filter(F.col("allocated_operational_tier").isin(tiers) & (F.col("audit_action_status") == "APPROVED")).count()
    done = jobs.dispatch_approved(spark, table, outbox, log, "run-1", "me", T(2024, 3, 2))
    assert done["customers"] == expected
    assert jobs.dispatch_approved(spark, table, outbox, log, "run-1", "me", T(2024, 3, 2)) == {"payloads": done["payloads"], "customers": 0}
    if expected:
        sent = [json.loads(r["value"]) for r in spark.read.text(outbox).collect()]
        assert sum(p["customers"] for p in sent if p["kind"] == "envelope") == sum(p["kind"] == "customer" for p in sent) == expected
        assert recent(read_audit_log(spark, log), "event_timestamp", "audit_id").count() == min(expected, 200)
