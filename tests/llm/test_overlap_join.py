import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import overlap_join as oj
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(rng, words, copies, edits):
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent,block", [(85, 400_000), (85, 300), (60, 500), (97, 400_000)])
def test_equals_brute_force(spark, make_docs, percent, block):
    rng = random.Random(percent + block)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for size, copies, edits in [(5, 4, 1), (8, 6, 1), (12, 8, 1), (40, 14, 3), (150, 14, 8), (700, 6, 40)]:
        texts += family(rng, [f"w{rng.randrange(500)}" for _ in range(size)], copies, edits)
    texts += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(12)] + passage) for _ in range(25)]
    texts += [None, "", "  ", "a", "A", "a b", "b a", "a b c d", "a b c d a b c d", "É b c d e", "é b c d e", texts[0].upper(), "x " * 500, "x " * 600]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = found(oj.jaccard_components(make_docs(docs), percent=percent, block_shingles=block))
    assert got == brute.jaccard_components(docs, percent=percent)


def test_search_equals_all_pairs():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64)) for _ in range(60)]
    sets = base + [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 900, len(b)).astype(np.uint64), b)) for b in base * 2]
    for percent in (50, 85, 95):
        root = oj.Components(len(sets))
        for i, a in enumerate(sets):
            for j in range(i):
                inter = len(np.intersect1d(a, sets[j]))
                if 100 * inter >= percent * (len(a) + len(sets[j]) - inter):
                    root.join(i, j)
        got = oj.search_links(sets, percent)
        names = {}
        assert all(names.setdefault(g, r) == r for g, r in zip(got, root.root)) and len(set(got)) == len(set(root.root))


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(6, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop, add = rng.integers(0, 1 + len(a) // 6), rng.integers(0, 1 + len(a) // 6)
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)])
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 85 * (len(a) + len(b) - inter) and len(a) != inter:
            assert set(oj.part_keys(a, 85)) & set(oj.part_keys(b, 85))


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in oj.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, 5000: 5000, 5001: 5000}


def test_edges(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([(2, text), (2, text), (None, text), (3, text), (3, "other words are here now"), (9, None)])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in oj.jaccard_components(docs).collect()), key=str)
    assert got == [(2, 27, 2), (2, 27, 2), (3, 2, 3), (3, 27, 2), (9, 0, 9), (None, 27, None)]
    assert oj.jaccard_components(docs.limit(0)).count() == 0
    wide = docs.withColumns({c: F.lit(1) for c in ("class", "group", "row", "n")})
    kept = oj.keep_one_of_each(wide)
    assert kept.columns == wide.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 2, 9, None]


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = found(QUERIES["op9_overlap_join"](spark, FOLDER))
    assert got == brute.jaccard_components(docs)
    assert len({c for _, c in got.values()}) < len(got)


def test_keys_come_with_the_classes_from_one_scan(spark):
    """Texts are cut into shingles once for sizes, classes and keys; a null id and a copy in the same task give no keys."""
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words, 0), (2, words, 0), (None, words + " more", 1), (3, None, 2), (4, "a b", 3)], "doc_id long, text string, row int").coalesce(1)
    found = {r.doc_id: r for r in oj._classes(docs, 4, 85).collect()}
    tokens = oj.Shingler(4).sets([oj.words_of(words)])[0]
    assert found[1].keys == oj.part_keys(tokens, 85).tolist() and found[1]["class"] == found[2]["class"] == oj.class_of(tokens)
    assert [found[d].n for d in (1, 2, None, 3, 4)] == [57, 57, 58, 0, 1] and all(found[d].keys == [] for d in (2, None, 3, 4))
    keys = oj._keys(oj.written(oj._classes(docs, 4, 85)))
    assert "MapInArrow" not in keys._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.key for r in keys.collect()) == sorted(found[1].keys) and {r["class"] for r in keys.collect()} == {found[1]["class"]}
