import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, schemas, sinks


def test_layouts_cover_all_raw_tables():
    assert len(schemas.RAW_SCHEMAS) == 21
    assert len(schemas.PREDICTIONS) == 13 and len(schemas.AUDIT_LOG) == 13


def test_csv_round_trip_and_bad_fields(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "user_account_id long, country_code string, tax_rate double")
    sinks.write_csv({"user_master_profiles": df}, folder)
    back = readers.read_csv(spark, f"{folder}/user_master_profiles.csv", df.schema)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", 1.5), (2, None, None)]
    (tmp_path / "bad.csv").write_text("a,b\n1,x\nnope,y\n")
    rows = readers.read_csv(spark, f"{folder}/bad.csv", schemas.layout_schema("a bigint, b string"), keep_corrupt=True).collect()
    assert [(r["a"], r["b"], r[readers.CORRUPT]) for r in rows] == [(1, "x", None), (None, "y", "nope,y")]


def test_layer_write_partition_and_truncate(spark, tmp_path):
    layer = str(tmp_path / "mart")
    df = spark.range(10).withColumn("activity_date", F.to_date(F.lit("2024-01-01")))
    sinks.write_layer({"t": df, "u": df}, layer, {"t": ["activity_date"]})
    tables = readers.read_layer(spark, layer, ["t", "u"])
    assert tables["t"].count() == 10 and (tmp_path / "mart" / "t" / "activity_date=2024-01-01").exists()
    sinks.truncate_layer(spark, layer, ["u"])
    again = readers.read_layer(spark, layer, ["u"])["u"]
    assert again.count() == 0 and again.columns == ["id", "activity_date"]


def test_versions_move_forward_and_keep_the_old_one(spark, tmp_path):
    table = str(tmp_path / "predictions")
    assert sinks.current_version(spark, table) is None
    assert sinks.write_versioned(spark.range(3), table) == 1
    grown = sinks.read_versioned(spark, table).union(spark.range(2))
    assert sinks.write_versioned(grown, table) == 2
    assert sinks.read_versioned(spark, table).count() == 5
    with pytest.raises(FileNotFoundError):
        sinks.read_versioned(spark, str(tmp_path / "nothing"))


def test_audit_log_checks_required_values_and_skips_empty_input(spark, tmp_path):
    path = str(tmp_path / "log")
    row = ("a1", "7", "SENT", "SUCCESS", dt.datetime(2024, 1, 1))
    schema = "audit_id string, user_account_id string, action_taken string, status string, event_timestamp timestamp_ntz"
    good = spark.createDataFrame([row], schema)
    assert sinks.append_audit_log(good.limit(0), path, "r0") == 0 and sinks.read_audit_log(spark, path).count() == 0
    assert sinks.append_audit_log(good, path, "r1") == 1 and sinks.append_audit_log(good, path, "r1") == 0
    assert sinks.append_audit_log(good.withColumn("audit_id", F.lit("a2")), path, "r2") == 1
    assert sinks.read_audit_log(spark, path).count() == 2 and len(sinks.read_audit_log(spark, path).columns) == 13
    with pytest.raises(Exception, match="required"):
        sinks.append_audit_log(good.withColumn("status", F.lit(None).cast("string")), path, "r3")
    with pytest.raises(ValueError, match="folder"):
        sinks.append_audit_log(good, path, "a/b")


def test_a_retried_run_replaces_its_own_partitions_only(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "audit_id string, user_account_id string, action_taken string, status string, event_timestamp timestamp_ntz"
    rows = lambda run, days: spark.createDataFrame([(f"{run}-{d}-{i}", "7", "SENT", "SUCCESS", dt.datetime(2024, 1, d)) for d in days for i in range(3)], schema)
    for run in ("a", "b", "c"):
        assert sinks.append_audit_log(rows(run, (1, 2)), path, run) == 6
    others = {f: f.stat().st_mtime_ns for f in (tmp_path / "log").rglob("*.parquet") if "run=b" not in str(f)}
    assert others and sinks.append_audit_log(rows("b", (1, 2)), path, "b") == 0
    assert {f: f.stat().st_mtime_ns for f in others} == others
    # a retry that has rows on one day less takes back the other day's
    assert sinks.append_audit_log(rows("b", (2,)), path, "b") == -3 and sinks.read_audit_log(spark, path).count() == 15
    # a run that died before its marker does not count
    rows("d", (1,)).withColumns({"event_day": F.to_date("event_timestamp"), "run": F.lit("d")}).write.mode("append").partitionBy("event_day", "run").parquet(path)
    assert sinks.read_audit_log(spark, path).count() == 15 and sinks.committed_run(spark, path, "b") == {"2024-01-02": 3}


def test_catalog_tables(spark, tmp_path):
    sinks.create_database(spark, "tidemark_test")
    try:
        sinks.create_table_as(spark.range(3), "tidemark_test.numbers")
        assert spark.table("tidemark_test.numbers").count() == 3
        for name in ("a", "b"):
            sinks.create_table_as(spark.range(1000), f"tidemark_test.{name}", bucket_by=(4, ["id"]))
        joined = spark.table("tidemark_test.a").hint("merge").join(spark.table("tidemark_test.b"), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1000
    finally:
        spark.sql("DROP DATABASE tidemark_test CASCADE")


def test_outbox_lines(spark, tmp_path):
    path = str(tmp_path / "outbox")
    for _ in range(2):
        sinks.write_outbox(spark.createDataFrame([('{"a": 1}',), ('{"a": 2}',)], "payload string"), path, "r1")
    assert sorted(r["a"] for r in spark.read.json(path).collect()) == [1, 2]


def test_an_unreadable_pointer_is_no_new_table(spark, tmp_path):
    table = str(tmp_path / "held")
    sinks.write_versioned(spark.range(3), table)
    spark.range(1).write.parquet(f"{table}/v00000002")           # left by a writer that died
    assert sinks.write_versioned(spark.range(4), table) == 3 and sinks.read_versioned(spark, table).count() == 4
    (tmp_path / "odd" / "_pointer").mkdir(parents=True)
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        sinks.current_version(spark, str(tmp_path / "odd"))
