import brute
import corpus_pipeline as cp
import public_tokenizers
import pytest
import test_curve_packing
import test_line_chunks
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage, each written and read by the next."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.cut_lineage(stage(spark, docs, FOLDER))
        out[name] = (rows_of(before), docs)
    return out


def test_language_keeps_clean_documents(stages):
    before, after = stages["language"]
    kept = rows_of(after)
    assert set(kept) <= set(before) and len(kept) > 0.97 * len(before)
    assert all(any(c.isalpha() for c in r[1]) for r in kept)


def test_lines_equal_brute_force(stages):
    before, after = stages["lines"]
    wanted = test_line_chunks.brute([r[:2] for r in before])
    expected = [(d, wanted[d][0], lang, source, len(wanted[d][0])) for d, _, lang, source, _ in before if wanted[d][0].strip() or not wanted[d][2]]
    assert rows_of(after) == sorted(expected, key=repr)


def test_lines_are_split_once(spark):
    """The filter and the new length read the cut text; they must not compute it again."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = cp.line_stage(spark, docs, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert all(line.count("split(") <= 1 and line.count("array_join(") <= 1 for line in plan.splitlines())


def test_copies_equal_brute_force(stages):
    before, after = stages["near copies"]
    components = brute.jaccard_components([r[:2] for r in before])
    assert rows_of(after) == [r for r in before if components[r[0]][1] == r[0]]


def test_benchmark_equals_brute_force(spark, stages):
    before, after = stages["benchmark"]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    judged = brute.winnow([r[:2] for r in before], items)
    assert rows_of(after) == [r for r in before if not judged[r[0]][-1]]


def test_packing_round_trip(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    test_curve_packing.check(after.collect(), {r[0]: test_curve_packing.ids_of(tokenizer, r[1]) for r in before})


def test_run_equals_stages(spark, stages):
    ran = cp.run(spark, FOLDER).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    staged = stages["packing"][1].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, staged))


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows and clashing names pass through every stage."""
    rows = [(None, "eine Zeile\nund noch eine", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "some words in a line", "en", "s", 5),
            (3, "some words in a line", "en", "s", 5), (4, "other words " * 3000, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {c: F.lit(1) for c in ("hash", "row", "class", "key", "span", "label", "score", "lang_pred", "n_lines", "n_removed", "__text")})
    for name, stage in cp.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, FOLDER)
            assert name == "packing" or out.columns == docs.columns
            out.collect()


def test_registered():
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is cp.run and len([n for n in entry.queries() if n.startswith("op")]) == 13 and len(QUERIES) == 13
