"""Signatures per file for searches in any column: a bitmap of the character triples that the file's values hold.

A search term of three characters or more can only be in a file that has all its triples, so the others are not opened.
A crowded bitmap opens more files, never fewer; files that came after the index are opened always. The rows that are read
are filtered by the same rule as without an index.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.filters import search_any

BUCKET = 32_768     # positions of one Spark bitmap
BUCKETS = 8         # bitmaps per file: 32 KB
WORD = 64           # places that are set together


def _positions(text: Column) -> Column:
    """Places of the distinct triples of a lower-cased text among all bits."""
    starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(3))), F.lit(BUCKET * BUCKETS))))


def signatures(spark: SparkSession, table: str) -> DataFrame:
    """file, bucket, bitmap of all files of a Parquet table.

    Bits are set per task first, in words of 64 places: numbers, whose aggregation is hashed and holds at most 4,096 of
    them per file however many rows it has. Binary bitmaps as the first step would have every place sorted in memory.
    """
    df = spark.read.parquet(table)
    texts = [F.lower(F.col(f"`{c}`").cast("string")) for c in df.columns]
    places = F.flatten(F.array(*[F.coalesce(_positions(t), F.array().cast("array<bigint>")) for t in texts]))
    bits = df.select(F.col("_metadata.file_path").alias("file"), F.explode_outer(places).alias("place"))
    # the lowest byte of places comes first in the word's hexadecimal form, as it does in the bitmap
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.expr("cast(56 - 8 * (place % 64 div 8) + place % 8 AS int)"))
    words = bits.groupBy("file", F.expr(f"cast(place div {WORD} AS int)").alias("word")).agg(F.bit_or(bit).alias("set"))
    per_bucket = BUCKET // WORD
    held = F.map_from_entries(F.collect_list(F.when(F.col("word").isNotNull(), F.struct(F.col("word") % per_bucket, F.col("set")))))
    bitmaps = words.groupBy("file", F.coalesce(F.expr(f"cast(word div {per_bucket} AS int)"), F.lit(0)).alias("bucket")).agg(held.alias("held"))
    text = F.transform(F.sequence(F.lit(0), F.lit(per_bucket - 1)), lambda w: F.lpad(F.hex(F.coalesce(F.col("held")[w], F.lit(0).cast("bigint"))), WORD // 4, "0"))
    return bitmaps.select("file", "bucket", F.unhex(F.array_join(text, "")).alias("bitmap"))


def write_signatures(spark: SparkSession, table: str, index: str) -> None:
    """Index all files of a Parquet table: file, bucket, bitmap."""
    signatures(spark, table).write.mode("overwrite").parquet(index)


def _has(place: int) -> Column:
    """Whether the bit of a place within its bucket is set in ``bitmap``."""
    byte = F.conv(F.hex(F.substring("bitmap", place // 8 + 1, 1)), 16, 10).cast("int")
    return byte.bitwiseAND(1 << place % 8) != 0


def _path(file: str) -> str:
    """Local paths come with one slash or with three."""
    return re.sub("^file:/+", "file:///", file)


def files_to_read(spark: SparkSession, table: str, index: str, term: str) -> list[str]:
    """Files of the table that can hold the term, by the index or because it does not know them."""
    every = spark.read.parquet(table).inputFiles()
    if len(term) < 3:
        return every
    wanted = spark.range(1).select(F.explode(_positions(F.lower(F.lit(term)))).alias("place"))
    wanted = [r["place"] for r in wanted.collect()]      # as many as the term has characters
    rows = spark.read.parquet(index)
    own = sum((F.when((F.col("bucket") == p // BUCKET) & _has(p % BUCKET), 1).otherwise(0) for p in wanted), F.lit(0))
    found = {_path(r["file"]): r["n"] == len(wanted) for r in rows.groupBy("file").agg(F.sum(own).alias("n")).collect()}
    return [f for f in every if found.get(_path(f), True)]


def search_indexed(spark: SparkSession, table: str, index: str, term: str) -> DataFrame:
    """Rows with the term in any column, ignoring case; equal to ``search_any(..., literal=True)`` over the whole table."""
    schema = spark.read.parquet(table).schema
    files = files_to_read(spark, table, index, term)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return search_any(rows, term, literal=True)
