"""Searches through file signatures: the same rows as a scan, from fewer files."""

from pyspark.sql import functions as F

from tidemark.operators.filters import search_any
from tidemark.sources import signatures as s


def test_equal_to_the_scan_from_fewer_files(spark, tmp_path):
    table, index = str(tmp_path / "t"), str(tmp_path / "i")
    df = spark.range(4000, numPartitions=1).select("id", F.concat(F.lit("Name#"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"),
                                                   F.when(F.col("id") % 5 > 0, F.concat(F.lit("Ort "), F.chr(65 + F.col("id") / 200))).alias("city"))
    df.repartitionByRange(16, "id").write.parquet(table)
    s.write_signatures(spark, table, index)
    every = spark.read.parquet(table).inputFiles()
    assert len(every) == 16
    rows = lambda d: sorted(map(str, d.collect()))
    for term, most in (("#001777", 1), ("ORT T", 2), ("t", 16), ("77", 16), ("nowhere at all", 0), ("name#", 16), ("", 16)):
        read = s.files_to_read(spark, table, index, term)
        assert len(read) <= most and set(read) <= set(every), term
        assert rows(s.search_indexed(spark, table, index, term)) == rows(search_any(spark.read.parquet(table), term, literal=True)), term
    # rows that came later are found without a new index
    spark.createDataFrame([(9, "late NOWHERE at all", None)], df.schema).write.mode("append").parquet(table)
    assert s.search_indexed(spark, table, index, "nowhere at all").count() == 1


def test_bits_are_set_without_a_sort_of_all_places(spark, tmp_path):
    """The memory of a task follows its files, not its rows: places are aggregated by hash, and give Spark's own bitmaps."""
    table = str(tmp_path / "t")
    spark.range(3000).select("id", F.concat(F.lit("N\u00e4me "), F.sha2(F.col("id").cast("string"), 256)).alias("name"), F.lit(None).cast("string").alias("gone")).repartition(3).write.parquet(table)
    spark.createDataFrame([(7, None, "ab")], "id long, name string, gone string").write.mode("append").parquet(table)
    found = s.signatures(spark, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    places = F.flatten(F.array(*[F.coalesce(s._positions(F.lower(F.col(c).cast("string"))), F.array().cast("array<bigint>")) for c in ("id", "name", "gone")]))
    bits = spark.read.parquet(table).select(F.col("_metadata.file_path").alias("file"), F.explode_outer(places).alias("place"))
    expected = bits.groupBy("file", F.coalesce((F.col("place") / s.BUCKET).cast("int"), F.lit(0)).alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % s.BUCKET).alias("bitmap"))
    rows = lambda d: sorted((r.file, r.bucket, bytes(r.bitmap)) for r in d.collect())
    assert rows(found) == rows(expected) and len(rows(found)) > 3 * s.BUCKETS - 1
