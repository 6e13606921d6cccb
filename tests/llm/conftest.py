import pathlib
import random
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

FOLDER = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """A documents table from (doc_id, text) pairs."""
    def make(pairs, partitions=3):
        rows = [(d, t, "en", "s", len(t or "")) for d, t in pairs]
        return spark.createDataFrame(rows, DOC_SCHEMA).repartition(partitions)
    return make


@pytest.fixture
def prose():
    """A repeatable maker of texts from a small vocabulary, so that passages repeat by chance."""
    def make(seed, n, vocabulary=40, sep=" "):
        rng = random.Random(seed)
        return sep.join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
    return make
