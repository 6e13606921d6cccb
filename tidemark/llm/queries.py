"""Registered queries of the numbered operators, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bag_search, box_negatives, compression_toxicity, curve_packing, language, line_chunks, mincut_html, overlap_join, perplexity, quotation, substring, wavelet, winnowing
from tidemark.llm.common import is_held_out, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


@query("op4_language_bayes")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", is_held_out(F.col("doc_id")))
    model = language.fit_language_model(docs.where("NOT held_out"))
    return language.identify_language(docs, model, keep=["doc_id", "held_out"])


@query("op1_perplexity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = perplexity.quality(read_table(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", *perplexity.BASE, "base_failed", "kept", "perplexity")


@query("op2_line_chunks", line_chunks.ORACLE)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks.remove_repeated_chunks(read_table(spark, folder, "documents").select("doc_id", "text"))


@query("op3_substring_windows", substring.ORACLE)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.remove_repeated_windows(read_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_hilbert_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return curve_packing.pack_documents(read_table(spark, folder, "documents"), with_ids=False)


@query("op6_mincut_html")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mincut_html.extract_text(read_table(spark, folder, "pages"), keep=["page_id", "url"])


@query("op7_quotation")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quotation.thread_messages(read_table(spark, folder, "conversations"))


@query("op8_winnowing", winnowing.ORACLE)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op9_overlap_join", overlap_join.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_join.jaccard_components(read_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op10_compression_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", is_held_out(F.col("doc_id")))
    labels = read_table(spark, folder, "labels").select("doc_id", "toxic").where(~is_held_out(F.col("doc_id")))
    model = compression_toxicity.fit_toxicity_model(docs.where("NOT held_out"), labels)
    return compression_toxicity.score_toxicity(docs, model, keep=["doc_id", "held_out"])


@query("op11_bag_search", bag_search.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return bag_search.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op12_wavelet_tokens")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.encode_and_read_back(read_table(spark, folder, "documents"))


@query("op13_box_negatives", box_negatives.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    moved = read_table(spark, folder, "embeddings").withColumn("label", F.expr(box_negatives.MOVED_LABEL))
    return box_negatives.mine(moved, F.expr(box_negatives.ANCHOR))
