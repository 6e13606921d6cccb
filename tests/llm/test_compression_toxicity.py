import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import compression_toxicity as ct
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"     # the largest single-file tables; half of its toxic words are not in English and rare
INSULTS = ["blockhead", "numbskull", "nitwit", "dunderhead"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tu", "re", "son", "ti", "el"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return ct.fit_toxicity_model(docs, labels)


def test_learns_planted_words(spark, fitted):
    fresh = corpus(200, 2)
    table = spark.createDataFrame(fresh, "doc_id long, text string, truth int")
    found = ct.score_toxicity(table, fitted).collect()
    assert sum(r.truth == r.predicted for r in found) > 0.95 * len(found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_savings_are_differences_of_lengths(fitted):
    savings = ct.Savings(fitted)
    text = "nitwit blockhead numbskull dunderhead nitwit blockhead lo mi"
    window, = ct.windows_of(text)
    assert savings.features(text)[1] == len(savings.plain.compress(window)) - len(savings.both.compress(window)) > 0


def test_whole_text_counts(spark, fitted):
    long_clean = "kalo miture " * 40_000
    rows = spark.createDataFrame([(1, long_clean), (2, long_clean + " ".join(INSULTS * 200))], "doc_id long, text string")
    a, b = sorted(ct.score_toxicity(rows, fitted).collect(), key=lambda r: r.doc_id)
    assert b.score > a.score


def test_edges(spark, fitted):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "  "), (3, "nitwit")], "doc_id long, text string").withColumn("score2", F.lit(1))
    found = ct.score_toxicity(docs, fitted).collect()
    assert len(found) == 5 and {r.predicted for r in found if r.doc_id != 3} == {0}
    assert ct.score_toxicity(docs.limit(0), fitted).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    empty = ct.fit_toxicity_model(docs, none)
    assert {r.score for r in ct.score_toxicity(docs, empty).collect()} == {0.0}


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op10_compression_toxicity"](spark, FOLDER).where("held_out").join(truth, "doc_id").toPandas()
    toxic, clean = found[found.toxic == 1], found[found.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.45 and (clean.predicted == 1).mean() < 0.03
