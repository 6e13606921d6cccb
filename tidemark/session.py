"""Session settings and lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Days exploded from intervals are already partitioned by their entity: a join on entity and day
    # then moves only the daily facts. Facts hold one row per entity and day, so no partition grows hot.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Recording the Python line of every expression costs more than planning a wide table.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "tidemark", master: str | None = None,
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings this library is tuned for.

    On a cluster leave ``master`` and ``shuffle_partitions`` to the submit command: a few tasks
    per executor core before AQE merges the small ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one below the shared warehouse folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    context.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def shared_folder(spark: SparkSession) -> str:
    """The folder below the checkpoint folder that belongs to this application and that all executors can read and write."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written copy.

    Used where several jobs read one result (fold loops, fit parameters): the copy survives the
    loss of executors and is not computed again.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
