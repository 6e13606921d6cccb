import numpy as np
import pytest

from tidemark.llm import language
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = QUERIES["op4_language_bayes"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_counts_equal_brute_force(spark):
    texts = [("ab ab", "x"), ("zz", "y"), (None, "x"), ("q", None), ("1 2", "y")]
    model = language.fit_language_model(spark.createDataFrame(texts, "text string, lang string").repartition(3))
    assert model.languages == ["x", "y"]
    want = []
    for lang in model.languages:
        sums = np.full(1 << language.BUCKET_BITS, language.SMOOTHING)
        for text, name in texts:
            if name == lang and text is not None:
                np.add.at(sums, language._grams([text])[0], 1)
        want.append(np.log(sums / sums.sum()))
    assert np.allclose(model.log_probs.T, want, atol=1e-5)
    assert np.allclose(model.log_priors, np.log([1 / 3, 2 / 3]))


def test_texts_do_not_touch():
    together, owners = language._grams(["ab", "cd"])
    assert sorted(together[owners == 0]) == sorted(language._grams(["ab"])[0])
    assert sorted(together[owners == 1]) == sorted(language._grams(["cd"])[0])


@pytest.mark.parametrize("text,known", [(None, False), ("", False), ("12 - ...", False), ("ß", True), ("日本", True), ("a" * 3_000_000, True)])
def test_und(spark, text, known):
    model = language.fit_language_model(spark.createDataFrame([("aß", "de"), ("b", "en")], "text string, lang string"))
    rows = spark.createDataFrame([(1, text, "zz", 0.5)], "doc_id long, text string, lang_pred2 string, __x double")
    row = language.identify_language(rows, model).collect()[0]
    assert (row.lang_pred != "und") == known and (0 < row.score <= 1 if known else row.score == 0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit_language_model(empty)
    assert language.identify_language(empty, model).count() == 0
    one = spark.createDataFrame([(1, "abc", "en"), (1, "abc", "en"), (None, "abc", None)], empty.schema)
    assert [r.lang_pred for r in language.identify_language(one, model).collect()] == ["und"] * 3


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the words of a line", "en"), (2, "die Wörter einer Zeile", "de")], "doc_id long, text string, lang string")
    model = language.fit_language_model(docs)
    wide = docs.selectExpr("*", "7 AS score", "8 AS lang_pred", "9 AS __text")
    found = language.identify_language(wide, model)
    assert found.columns == ["doc_id", "text", "lang", "__text", "lang_pred", "score"]
    assert {(r.lang_pred == r.lang, 0 < r.score <= 1, r["__text"]) for r in found.collect()} == {(True, True, 9)}
    assert {(r.score, r.lang_pred, r.a == r.lang) for r in language.identify_language(wide, model, results=("a", "b")).collect()} == {(7, 8, True)}
