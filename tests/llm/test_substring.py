import brute
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import substring
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def digest(rows):
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows.collect()}


@pytest.mark.parametrize("span,anchor,vocabulary", [(50, 16, 40), (8, 3, 3), (5, 5, 4), (3, 1, 6)])
def test_equals_brute_force(spark, make_docs, prose, span, anchor, vocabulary):
    shared = [prose(900 + i, 30 + 17 * i, vocabulary) for i in range(4)]
    docs = [(i, f"{prose(i, i, vocabulary)} {shared[i % 4]}\n{prose(50 + i, 2 * i, vocabulary)}") for i in range(25)]
    docs += [(90, docs[3][1]), (91, docs[3][1] + " tail"), (92, None), (93, ""), (94, " \n\t "), (95, "a " * 400), (96, "b " + "a " * 300), (97, "x y z")]
    assert digest(substring.remove_repeated_windows(make_docs(docs), span=span, anchor=anchor)) == brute.repeated_windows(docs, span)


def test_edges(spark, make_docs, prose):
    text = prose(1, 60)
    docs = make_docs([(2, text), (2, text), (None, text), (3, text), (1, "short")])
    found = sorted(((r.doc_id, r.n_removed) for r in substring.remove_repeated_windows(docs).collect()), key=str)
    assert found == [(1, 0), (2, 0), (2, 0), (3, 60), (None, 0)]
    assert substring.remove_repeated_windows(docs.limit(0)).count() == 0
    wide = docs.select("doc_id", "text").withColumns({c: F.lit(1) for c in ("row", "runs", "anchor", "start", "n", "first", "before")})
    assert substring.remove_repeated_windows(wide).count() == 5


def test_section_repeated_inside_a_later_document(spark, make_docs, prose):
    docs = []
    for i in range(20):
        passage, head, tail = prose(f"p{i}", 51 + 2 * i, 5000), prose(f"h{i}", 40, 5000), prose(f"t{i}", 40, 5000)
        docs.append((2 * i, f"{prose(f'a{i}', 45, 5000)} {passage} {prose(f'b{i}', 45, 5000)}"))
        docs.append((2 * i + 1, f"{head} {passage} {tail} " * 2))
    assert digest(substring.remove_repeated_windows(make_docs(docs))) == brute.repeated_windows(docs)


def test_section_in_two_rows_of_one_id(spark, make_docs, prose):
    docs, section = [], {}
    for i in range(20):
        passage, head, tail = prose(f"p{i}", 51 + 2 * i, 5000), prose(f"h{i}", 40, 5000), prose(f"t{i}", 40, 5000)
        docs += [(2 * i, f"{prose(f'a{i}', 45, 5000)} {passage}")] + [(2 * i + 1, f"{n} {head} {passage} {tail}") for n in ("x", "y", "y")]
        section[2 * i + 1] = 51 + 2 * i
    found = [(r.doc_id, r.n_removed) for r in substring.remove_repeated_windows(make_docs(docs)).collect() if r.doc_id % 2]
    assert sorted(found) == sorted((d, n) for d, n in section.items() for _ in range(3))


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op3_substring_windows"](spark, FOLDER).collect()}
    assert found == brute.repeated_windows(docs)
    assert sum(x[1] for x in found.values()) > 0
