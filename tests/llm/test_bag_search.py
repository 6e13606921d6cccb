import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bag_search as b

LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=10):
    """Rows (item_id, rank, doc_id, score) by scoring every document for every distinct (id, text)."""
    tf = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c in tf:
            m = 25 + (75 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def item_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_terms", [1_000_000, 60])
def test_equals_brute_force(spark, make_docs, block_terms):
    rng = random.Random(block_terms)
    texts = [" ".join(f"W{min(60, int(rng.expovariate(0.08)))}x" for _ in range(rng.randrange(1, 40))) for _ in range(250)]
    docs = list(enumerate(texts + texts[:40] * 2))
    items = [(i, " ".join(f"w{rng.randrange(70)}X," for _ in range(12))) for i in range(25)]
    found = b.search(make_docs(docs), item_table(spark, items), block_terms=block_terms)
    assert got(found) == brute(docs, items)


def test_a_large_group_of_copies_is_one_class(spark, make_docs):
    docs = [(i, "red green blue") for i in range(400)] + [(1000 + i, f"red other{i}") for i in range(30)]
    items = [(1, "red blue"), (2, "green"), (3, "nothing")]
    assert got(b.search(make_docs(docs, 9), item_table(spark, items))) == brute(docs, items)


def test_edges(spark, make_docs):
    docs = [(1, None), (2, ""), (3, "..."), (4, "ÄÖ äö x"), (5, "word " * 30_000), (6, "A b\u0000C"), (6, "A b\u0000C"), (7, "a b c"), (None, "a b c"), (8, "x\ny")]
    items = [(1, None), (2, ""), (3, "Äö X x"), (4, "word word"), (5, "A a b"), (5, "A a b"), (None, "c"), (6, "!")]
    clashing = make_docs(docs).withColumns({c: F.lit(7) for c in ("n", "bag", "digest", "m", "score", "rank", "item_id", "item")})
    assert got(b.search(clashing, item_table(spark, items).withColumns({"doc_id": F.lit(1), "score": F.lit(2), "term": F.lit(3)}))) == brute(docs, items)
    assert got(b.search(make_docs(docs).limit(0), item_table(spark, items))) == []
    assert got(b.search(make_docs(docs), item_table(spark, items).limit(0))) == []
    assert got(b.search(make_docs([(1, None), (2, "")]), item_table(spark, items))) == []


def test_bags_round_trip():
    import numpy as np
    bags = [b.encode_bag(np.array([3, 9]), np.array([1, 2])), b.encode_bag(np.array([70_000]), np.array([300]))]
    owner, numbers, counts = b.decode_bags(bags)
    assert owner.tolist() == [0, 0, 1] and numbers.tolist() == [3, 9, 70_000] and counts.tolist() == [1, 2, 300]


def test_members_are_expanded_from_ten_ids_a_class(spark, make_docs):
    """No plan node emits members times items: a class of 3000 rows that wins for 40 items leaves ten rows each."""
    docs = [(i, "red green") for i in range(3000)] + [(5000 + i, "green") for i in range(300)]
    items = [(i, "red") for i in range(40)]
    found = b.search(make_docs(docs, 6), item_table(spark, items))
    assert {r[2] for r in got(found)} == set(range(10))
    assert found._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4
