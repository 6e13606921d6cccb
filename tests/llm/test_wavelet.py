import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import wavelet as w
from tidemark.llm.queries import QUERIES
from tidemark.session import shared_folder

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def matrix_of(values):
    return w.read_file(w.write_file([7], [np.array(values, np.uint32)]))[2]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([0, 2, 5, 49407, 70000, 300, 301]), min_size=1, max_size=1500))
def test_matrix_answers_like_a_list(values):
    m = matrix_of(values)
    assert m.decode().tolist() == values
    assert m.access(np.arange(len(values))).tolist() == values
    end = len(values) * 2 // 3
    for symbol in {*values, 1}:
        where = [i for i, v in enumerate(values) if v == symbol]
        assert m.select(symbol).tolist() == where
        assert m.rank(symbol) == len(where) and m.rank(symbol, end) == sum(i < end for i in where)
        if where:
            assert m.select(symbol, [len(where) - 1]).tolist() == where[-1:]


def test_matrix_over_many_blocks():
    rng = np.random.default_rng(1)
    values = np.minimum(rng.zipf(1.3, 40_000), 49_000)
    m = matrix_of(values)
    at = rng.integers(0, len(values), 500)
    assert (m.access(at) == values[at]).all() and (m.decode() == values).all()
    for symbol in (1, 2, 17, 49_000):
        assert (m.select(symbol) == np.flatnonzero(values == symbol)).all() and m.rank(symbol, 33_333) == (values[:33_333] == symbol).sum()


def test_query_equals_the_tokenizer(spark, tokenizer):
    start = 0
    got = {r.doc_id: r for r in QUERIES["op12_wavelet_tokens"](spark, FOLDER).collect()}
    docs = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(docs)
    for d in docs:
        ids = ids_of(tokenizer, d.text)
        assert got[d.doc_id][:4] == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_lookups_over_shards(spark, make_docs, tokenizer, prose):
    docs = [(i, prose(i, 5 + i % 60, 9)) for i in range(300)]
    path = f"{shared_folder(spark)}/wavelet-test"
    w.write_token_files(make_docs(docs), path, shard_tokens=400)
    flat = [(d, k, t) for d, text in docs for k, t in enumerate(ids_of(tokenizer, text))]
    assert spark.read.parquet(path).count() > 10
    assert [list(r.ids) for r in w.read_documents(spark, path, with_ids=True).orderBy("doc_id").collect()] == [ids_of(tokenizer, t) for _, t in docs]
    token = flat[3][2]
    found = sorted(map(tuple, w.find_token(spark, path, token).collect()))
    assert found == sorted((d, p, k) for p, (d, k, t) in enumerate(flat) if t == token)
    assert w.count_token(spark, path, token).agg(F.sum("n")).first()[0] == len(found)
    assert w.count_token(spark, path, 49_000).agg(F.sum("n")).first()[0] == 0
    assert [r.token for r in w.tokens_at(spark, path, 350, 900).orderBy("position").collect()] == [t for _, _, t in flat[350:1250]]


def test_edges(spark, make_docs, tokenizer):
    texts = [None, "", " ", "x<|endoftext|>y", "日本語 тест é", "a b\u0085c\x1cd\x1f e\xa0f", "w " * 30_000, "it's you'LL\n\n  z \t", "a" * 5_000, "İstanbul ÀÉ"]
    docs = make_docs(list(enumerate(texts)), 4)
    clashing = docs.withColumns({"digest": F.lit("x"), "row": F.lit(1), "file": F.lit(2), "start": F.lit(3), "part": F.lit(4)})
    got = w.encode_and_read_back(clashing, shard_tokens=50).orderBy("doc_id").collect()
    start = 0
    for i, t in enumerate(texts):
        ids = ids_of(tokenizer, t)
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    assert w.encode_and_read_back(docs.limit(0)).collect() == []
    same = w.encode_and_read_back(make_docs([(1, "b c")] * 3 + [(1, "a"), (None, "z")])).orderBy("start").collect()
    assert [r.doc_id for r in same] == [None, 1, 1, 1, 1] and [r.start for r in same] == np.cumsum([0, *(r.n_tokens for r in same[:-1])]).tolist()
    with pytest.raises(ValueError):
        w.read_file(b"none of this")


def test_chunks_equal_whole_texts(tokenizer):
    rng = random.Random(5)
    chars = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2030), 0x20AC, 0x301]]
    texts = ["".join(rng.choice(chars if rng.random() < 0.4 else "abC 'sTt.1\n") for _ in range(200)) for _ in range(600)]
    known = w.chunk_ids(w.TOKENIZER)
    assert [i.tolist() for i in known.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_of_letters_need_no_pattern(monkeypatch):
    """Ids are the library's, and a chunk of letters alone is taken as the word that it is."""
    class Seen:
        def __init__(self, pattern):
            self.pattern, self.chunks = pattern, []

        def findall(self, chunk):
            self.chunks.append(chunk)
            return self.pattern.findall(chunk)

    seen = Seen(w.WORDS)
    monkeypatch.setattr(w, "WORDS", seen)
    texts = ["Ein l\u00e4ngerer Text, it's x2 \u00bd a\u00aab \u0130 \u0131 \u00b5 \u01c5 \u1e9e", "plain words only", "", "\x1c a\x1db", "'s s' ''ll we'll"]
    encoder = w.ChunkIds(w.TOKENIZER)
    assert [e.tolist() for e in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert seen.chunks and not any(c.isalpha() for c in seen.chunks)


def test_words_are_kept_in_arrays_and_cut_at_once(monkeypatch):
    """One search cuts all chunks of a call, words are no objects of their own, known ones are not encoded again."""
    class Seen:
        def __init__(self, target, name):
            self.target, self.calls = getattr(target, name), []
            monkeypatch.setattr(target, name, self)

        def findall(self, text):
            self.calls.append(text)
            return self.target.findall(text)

        def encode_batch_fast(self, texts, **options):
            self.calls.append([t for t in texts if t])
            return self.target.encode_batch_fast(texts, **options)

    encoder = w.ChunkIds(w.TOKENIZER)
    library, pattern = Seen(encoder, "tokenizer"), Seen(w, "WORDS")
    every = [chr(c) for c in range(0x2100) if not w.OTHER.search(chr(c))]
    texts = [" ".join(f"n{i}, {i}-x it's" for i in range(300)), "", "".join(every), " ".join(f"a{c}'ll{c}{c}1" for c in every), " ".join(f"b{c} {c}" for c in every), "n1, y n1,z"]
    expected = [library.target.encode(t, add_special_tokens=False).ids for t in texts]
    assert [e.tolist() for e in encoder.encode(texts)] == expected
    assert len(pattern.calls) == 1
    assert len(encoder.words.unique()) == len(encoder.words) == len(encoder.ends) - 1 and encoder.ends[-1] == len(encoder.ids)
    library.calls.clear()
    assert [e.tolist() for e in encoder.encode(texts[::-1])] == expected[::-1]
    assert not any(library.calls)
    monkeypatch.setattr(w, "KNOWN", 10)        # more are known by now: all are forgotten
    assert encoder.encode(["n2, new"])[0].tolist() == library.target.encode("n2, new", add_special_tokens=False).ids
    assert encoder.words.to_pylist() == ["new", "n", "2", ","]
    for text in ("xq" * 400, "few"):           # one word of more ids than are kept
        assert encoder.encode([text])[0].tolist() == library.target.encode(text, add_special_tokens=False).ids
    assert encoder.words.to_pylist() == ["few"]
