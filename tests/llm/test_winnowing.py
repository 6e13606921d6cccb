import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import winnowing
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def as_rows(found):
    picked = found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256), "contaminated")
    return {r[0]: tuple(r[1:]) for r in picked.collect()}


@pytest.mark.parametrize("span,gram", [(13, 5), (6, 2), (4, 4)])
def test_equals_brute_force(spark, make_docs, prose, span, gram):
    items = [(i, prose(i, n, 6)) for i, n in enumerate([40, 13, 12, 5, 1, 0, 20, 13])] + [(8, None), (9, "Été déjà-vu, one")]
    docs = [(i, prose(100 + i, 5 * i, 6)) for i in range(30)]
    docs += [(50, None), (51, ""), (52, "-- ,, "), (53, items[0][1].upper()), (54, "x " + items[1][1] + " y"), (55, "ÉTÉ été déjà vu one"),
             (56, " ".join([items[0][1]] * 50)), (57, "w0")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert as_rows(winnowing.contamination(make_docs(docs), table, span=span, gram=gram)) == brute.winnow(docs, items, span)


def test_edges(spark, make_docs):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    docs = make_docs([(1, "a b c d e f g h i j k l m"), (1, "a b c d e f g h i j k l m"), (1, "other"), (None, "a b c d e f g h i j k l m")])
    found = sorted(((r.doc_id, r.n_hit) for r in winnowing.contamination(docs, items).collect()), key=str)
    assert found == [(1, 0), (1, 13), (None, 13)]          # equal rows are one, other texts are apart, a null id stays
    assert [r.doc_id for r in winnowing.drop_contaminated(docs, items).collect()] == [None]
    assert winnowing.contamination(docs.limit(0), items).count() == 0
    none = winnowing.contamination(docs, items.limit(0)).collect()
    assert {r.n_hit for r in none} == {0} and not any(r.contaminated for r in none)
    wide = docs.withColumn("item_id", F.lit(1)).withColumn("hits", F.lit("x")).withColumn("span", F.lit(0))
    assert winnowing.drop_contaminated(wide, items).columns == wide.columns


def test_threshold_is_exact(spark, make_docs):
    items = spark.createDataFrame([(1, "only")], "item_id long, text string")
    docs = make_docs([(1, " ".join(["only"] + ["z"] * 19)), (2, " ".join(["only"] + ["z"] * 20))])
    assert {r.doc_id: r.contaminated for r in winnowing.contamination(docs, items).collect()} == {1: True, 2: False}


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op8_winnowing"](spark, FOLDER).collect()}
    assert found == brute.winnow(docs, items)
    assert any(x[-1] for x in found.values())
