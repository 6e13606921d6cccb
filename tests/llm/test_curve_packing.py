import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import curve_packing as cp
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(pieces, wanted, length=1024):
    """Exact round trip: every document's ids, each in one piece; sequences without gaps; no padding but at the ends."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(wanted)
    for doc, ids in wanted.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            if "ids" in p.__fields__:
                assert list(p.ids) == ids[at:at + p.length]
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or at < length and at & (at - 1) == 0
    return by_sequence


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_query_round_trip(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    sequences = check(QUERIES["op5_hilbert_packing"](spark, FOLDER).collect(), {d.doc_id: ids_of(tokenizer, d.text) for d in docs})
    full = sum(sum(p.length for p in s) == 1024 for s in sequences.values())
    assert full > 0.85 * len(sequences)


def test_edges(spark, make_docs, tokenizer):
    texts = [None, "", " ", "a" * 5000, "x<|endoftext|>y", "日本語 тест é", "a b\u0085c\x1cd", "w " * 30000, "it's you'LL\n\n  z \t"]
    docs = make_docs(list(enumerate(texts)))
    pieces = cp.pack_documents(docs.withColumns({"key": F.lit("x"), "ids": F.lit(1), "length": F.lit(2)}), length=64)
    check(pieces.collect(), {i: ids_of(tokenizer, t) for i, t in enumerate(texts)}, 64)
    assert cp.pack_documents(docs.limit(0)).count() == 0
    twice = cp.pack_documents(make_docs([(1, "one two"), (1, "one two"), (None, "x")])).collect()
    assert sum(p.length for p in twice if p.doc_id == 1) == 6 and sum(p.length for p in twice if p.doc_id is None) == 2


def test_fast_ids_equal(tokenizer):
    rng = random.Random(3)
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    texts = ["".join(rng.choice(chars if rng.random() < 0.5 else "ab 'st.1\n") for _ in range(300)) for _ in range(400)]
    assert cp.token_encoder("byte_bpe_50k.json")(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_hilbert_curve_visits_neighbours():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    keys = cp.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_copies_are_neighbours():
    same = [np.arange(50), np.arange(500, 900), np.arange(50)]
    keys = cp.curve_keys(same)
    assert keys[0] == keys[2] != keys[1]


def test_long_pieces_are_found_without_a_search_of_plain_texts(monkeypatch):
    n = cp.LONG
    for text in ("", "a b " * 2000, "a" * (n - 1), "a" * n, " " * n, "x " * 700 + "a" * n, "x " * 701 + "a" * (n - 1) + " b", "a b" + "\n" * n,
                 "y" * 999 + " " + "\t" * (n - 1) + "z", "\u00a0" * n, "a\n" * n, "\x1c" * n, "ab " + "\x1c" * (n - 1), "a" * 1500 + "\u2003" + "b" * 1999):
        assert cp.has_long_piece(text) == (cp.LONG_PIECE.search(text) is not None), (len(text), text[:5])
    monkeypatch.setattr(cp, "LONG_PIECE", None)      # ordinary prose must not need the dear pattern
    assert not cp.has_long_piece("some ordinary words of a text " * 500)
