"""Writers: layers, CSV export, versioned keyed tables, append-only logs and JSON outboxes.

Plain Parquet has no MERGE. A keyed table is therefore a folder of numbered versions plus a small
pointer: a rewrite goes to a new version, and only then the pointer moves. A job that dies in
between leaves the old version current, and no job overwrites the files it reads.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidemark.session import cut_lineage
from tidemark.sources.schemas import AUDIT_LOG, AUDIT_LOG_REQUIRED

RUN_ID = re.compile(r"[A-Za-z0-9._-]+")


def write_layer(tables: Mapping[str, DataFrame], layer: str, partition_by: Mapping[str, list[str]] | None = None,
                sort_by: Mapping[str, list[str]] | None = None) -> None:
    """Overwrite each table of a layer. The loop only submits jobs; each write is distributed."""
    for name, df in tables.items():
        columns = (partition_by or {}).get(name)
        if columns:
            # One shuffle by the partition columns keeps the file count down; AQE splits hot days.
            df = df.hint("rebalance", *columns)
        if (sort_by or {}).get(name):
            df = df.sortWithinPartitions(*(columns or []), *sort_by[name])
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*columns) if columns else writer).parquet(f"{layer}/{name}")


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def create_table_as(df: DataFrame, table: str, partition_by: list[str] | None = None,
                    bucket_by: tuple[int, list[str]] | None = None) -> None:
    """Catalog table from a query. Tables with equal buckets on their join key join without a shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        count, columns = bucket_by
        writer = writer.bucketBy(count, *columns).sortBy(*columns)
    writer.saveAsTable(table)


def truncate_layer(spark: SparkSession, layer: str, names: list[str]) -> None:
    """Empty the tables of a layer and keep their schemas."""
    for name in names:
        path = f"{layer}/{name}"
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_csv(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def _unless_absent(error: AnalysisException) -> None:
    """Only a path that does not exist counts as no table; a folder that cannot be read is a fault."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


def current_version(spark: SparkSession, table: str) -> int | None:
    try:
        return spark.read.parquet(f"{table}/_pointer").agg(F.max("version")).first()[0]
    except AnalysisException as error:
        _unless_absent(error)
        return None


def read_versioned(spark: SparkSession, table: str) -> DataFrame:
    version = current_version(spark, table)
    if version is None:
        raise FileNotFoundError(f"{table} has no committed version")
    return spark.read.parquet(f"{table}/v{version:08d}")


def write_versioned(df: DataFrame, table: str) -> int:
    """Write the next version of a table and make it current; returns its number."""
    spark = df.sparkSession
    version = (current_version(spark, table) or 0) + 1
    while True:      # a number that another writer, or one that died, has taken is passed over
        try:
            df.write.mode("errorifexists").parquet(f"{table}/v{version:08d}")
            break
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            version += 1
    pointer = spark.range(1).select(F.lit(version).alias("version"))
    # Appending never removes the earlier pointer, so readers always find a committed version.
    pointer.coalesce(1).write.mode("append").parquet(f"{table}/_pointer")
    return version


def _log_marker(path: str, run_id: str) -> str:
    return f"{path}/_commits/run={run_id}"


def append_audit_log(df: DataFrame, path: str, run_id: str) -> int:
    """Write one run's log rows in the declared layout below ``event_day=<day>/run=<run>`` and commit them; returns rows added.

    The input is evaluated once: a row without a required value fails the write, and a run counts only once its marker
    is there. A retry replaces its own run's partitions and nothing else is read or written, however long the log is.
    Empty input commits nothing.
    """
    if not RUN_ID.fullmatch(run_id):
        raise ValueError(f"run id {run_id!r} cannot name a folder")
    spark = df.sparkSession

    def value(field) -> Column:
        filled = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if field.name not in AUDIT_LOG_REQUIRED:
            return filled.alias(field.name)
        refusal = F.raise_error(F.lit(f"an audit row lacks the required value {field.name}")).cast(field.dataType)
        return F.coalesce(filled, refusal).alias(field.name)

    before = committed_run(spark, path, run_id)
    rows = df.select(*[value(f) for f in AUDIT_LOG.fields]).withColumns({"event_day": F.to_date("event_timestamp"), "run": F.lit(run_id)})
    ready = cut_lineage(rows)
    days = ready.groupBy("event_day").agg(F.count(F.lit(1)).alias("rows")).collect()
    if not days and not before:
        return 0
    ready.hint("rebalance", "event_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_day", "run").parquet(path)
    marker = spark.createDataFrame([(str(r["event_day"]), r["rows"]) for r in days], "event_day string, rows long")
    marker.coalesce(1).write.mode("overwrite").json(_log_marker(path, run_id))
    return sum(r["rows"] for r in days) - sum(before.values())


def committed_run(spark: SparkSession, path: str, run_id: str) -> dict[str, int]:
    """Rows per event day of a committed run, from its marker alone; empty where there is none."""
    try:
        return {r["event_day"]: r["rows"] for r in spark.read.schema("event_day string, rows long").json(_log_marker(path, run_id)).collect()}
    except AnalysisException as error:
        _unless_absent(error)
        return {}


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of committed runs, in the declared layout; the event day prunes partitions.

    A run's rows count on the days its marker lists: what a run that died has left, or an earlier try on another day, does not.
    """
    layout = T.StructType([*AUDIT_LOG.fields, T.StructField("event_day", T.DateType()), T.StructField("run", T.StringType())])
    try:
        markers = spark.read.schema("event_day string, rows long, run string").json(f"{path}/_commits")
    except AnalysisException as error:
        _unless_absent(error)
        return spark.createDataFrame([], AUDIT_LOG)
    committed = markers.select(F.to_date("event_day").alias("event_day"), "run")
    rows = spark.read.schema(layout).option("basePath", path).parquet(path).join(committed, ["event_day", "run"], "left_semi")
    return rows.select(*[f.name for f in AUDIT_LOG.fields])


def write_outbox(payloads: DataFrame, path: str, run_id: str, column: str = "payload") -> None:
    """One JSON document per line below the run's own folder; repeating a run replaces its documents."""
    payloads.select(F.col(column).alias("value")).write.mode("overwrite").text(f"{path}/run={run_id}")
