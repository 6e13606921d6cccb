"""The corpus pipeline: language, repeated lines, near copies, benchmark passages, packing.

Each stage reads the documents that its predecessor kept and returns documents; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import curve_packing, language, line_chunks, overlap_join, winnowing
from tidemark.llm.common import read_table
from tidemark.session import cut_lineage

MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents at hand; drop those without a letter or without a language that is likelier than not."""
    scored = language.identify_language(docs, language.fit_language_model(docs), results=("__lang", "__score"))
    return scored.where((F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated chunks of lines; a document of which nothing but white space is left goes."""
    cut = line_chunks.remove_repeated_chunks(docs, counts=("__all", "__removed"))
    emptied = (F.col("__removed") > 0) & ~F.col("text").rlike(r"\S")
    return cut.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the least id."""
    return overlap_join.keep_one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth of the words stands in windows of the benchmark."""
    return winnowing.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return curve_packing.pack_documents(docs)


STAGES = [("language", language_stage), ("lines", line_stage), ("near copies", copies_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]
#: SQL cannot express the language model, the tokenizer or the curve; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is cut from its lineage before the next stage reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
