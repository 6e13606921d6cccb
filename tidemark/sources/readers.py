"""Readers with fixed schemas: no inference pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.schemas import RAW_SCHEMAS

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    """CSV with a header; malformed fields become NULL, optionally keeping the raw line."""
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", False).csv(path))


def parse_lines(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """The same reading for CSV lines that are already in a table."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return df.select(F.from_csv(column, schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")


def read_raw(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, DataFrame]:
    """All raw tables of a folder, lazily."""
    return {name: read_csv(spark, f"{folder}/{name}{suffix}", schema) for name, schema in RAW_SCHEMAS.items()}


def read_layer(spark: SparkSession, layer: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{layer}/{name}") for name in names}


def read_database(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
                  partitions: int, **options: str) -> DataFrame:
    """A SQL table over JDBC, read in parallel slices of a numeric column."""
    reader = spark.read.format("jdbc").options(**options).option("url", url).option("dbtable", table)
    return (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
            .option("upperBound", upper).option("numPartitions", partitions).load())
