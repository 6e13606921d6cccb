import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import perplexity as px
from tidemark.llm.common import RollingHash, WordHashes
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(triples)
    covered = {j for i, t in enumerate(triples) if times[t] > 1 for j in range(i, i + 3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def brute_model(texts):
    """Modified Kneser-Ney over characters with plain dictionaries; (text, lang) in, a function of (lang, n-gram) out."""
    tables = {}
    for text, lang in texts:
        for i in range(len(text) - px.ORDER + 1):
            tables.setdefault(lang, collections.Counter())[text[i:i + px.ORDER]] += 1
    models = {}
    for lang, counts in tables.items():
        levels = {px.ORDER: counts}
        for n in range(px.ORDER - 1, 0, -1):
            levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
        models[lang] = levels

    def prob(lang, gram):
        if not gram:
            return 2.0 ** -px.SYMBOL_BITS
        counts = models[lang][len(gram)]
        times = collections.Counter(counts.values())
        d = px.discounts_of(len(gram), times[1], times[2], times[3], times[4])
        after = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        lower = prob(lang, gram[1:])
        if not after:
            return lower
        less = lambda c: d[min(c, 3) - 1]
        c = counts.get(gram, 0)
        return ((c - less(c) if c else 0) + sum(map(less, after.values())) * lower) / sum(after.values())
    return prob


def test_model_equals_brute_force(spark):
    rows = [("the cat sat on the mat and the rat", "en"), ("that hat is the cat's hat, that is that", "en"), ("le chat est sur le tapis été", "fr"), ("abcd", "fr"), (None, "en")] * 2 + [("xyzxyzxyz", None)]
    model = px.fit_perplexity(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    prob = brute_model([(t, lang or px.NO_LANGUAGE) for t, lang in rows if t])
    for lang, text in [("en", "the rat sat on that hat"), ("fr", "le chat était là"), ("", "xyzxyq"), ("en", "zzzzzzz")]:
        keys, _ = px.packed_grams([text])
        wanted = [math.log(prob(lang, text[i:i + px.ORDER])) for i in range(len(text) - px.ORDER + 1)]
        assert np.allclose(px.log_probabilities(model, keys, lang), wanted, atol=1e-4)


def test_probabilities_sum_to_one(spark):
    model = px.fit_perplexity(spark.createDataFrame([("abracadabra alakazam", "x")], "text string, lang string"))
    for context in ("abra", "zzzz", "kaza"):
        codes = np.array([ord(c) for c in context])
        key = 0
        for c in codes:
            key = key << px.SYMBOL_BITS | int(c)
        keys = (key << px.SYMBOL_BITS) | np.arange(1 << px.SYMBOL_BITS)
        assert np.exp(px.log_probabilities(model, keys, "x")).sum() == pytest.approx(1, abs=1e-3)


def noise(seed, n):
    return "".join(np.random.default_rng(seed).choice(list("abcdefghijklmnopqrstuvwxyz "), n)) * 2


def test_other_languages_change_nothing(spark):
    """Every n-gram has an entry of its own, however many there are."""
    own = [(noise(1, 20_000), "a")]
    others = [(noise(10 + i, 40_000), f"l{i}") for i in range(12)]
    keys = np.unique(px.packed_grams([own[0][0]])[0])
    alone, among = (px.fit_perplexity(spark.createDataFrame(rows, "text string, lang string")) for rows in (own, own + others))
    assert np.allclose(px.log_probabilities(alone, keys, "a"), px.log_probabilities(among, keys, "a"), atol=1e-6)
    assert sum(len(t[0]) for shard in among.grams[-1] for t in shard.value.values()) > 12 * 39_000


def test_shards_change_nothing(spark, monkeypatch):
    rows = [(i, noise(i, 3000) + "x" * i, "ab"[i % 2]) for i in range(30)] + [(None, None, None), (7, "ab", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def scores():
        model = px.fit_perplexity(docs)
        return model, sorted((r.doc_id or -1, r.perplexity or 0) for r in px.score_documents(docs, model).collect())
    whole, wanted = scores()
    monkeypatch.setattr(px, "SHARD_ENTRIES", 9000)
    monkeypatch.setattr(px, "HELD_BYTES", 0)
    monkeypatch.setattr(px, "TEXT_SLICE", 5000)
    cut, found = scores()
    assert whole.held and not cut.held and len(whole.grams[-1]) == 1 and len(cut.grams[-1]) > 5
    assert np.allclose(found, wanted)


@pytest.mark.parametrize("text", [None, "", " \n", "a b c a b c", "a b c d", "x x x x", "l\nl\n \nl \n l\nl", "# * & été x y\x0bz\x1cw", "a b\na b\na b c"])
def test_base_counts(text):
    assert px.base_counts([text, "a b c"], WordHashes(), RollingHash())[0].tolist() == brute_base(text)


def test_query_base_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op1_perplexity"](spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        base = brute_base(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.kept and r.base_failed)
    good = [r for r in found if not r.base_failed]
    assert sum(r.kept for r in good) > 0.9 * len(good)


def test_bands_reject_noise_and_repetition(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 8))) for _ in range(300)]
    docs = [(i, " ".join(rng.choice(vocabulary, 120)), "en") for i in range(150)]
    docs.append((900, " ".join("".join(rng.choice(list("qxzjkvwy0#~"), 9)) for _ in range(80)), "en"))
    docs.append((901, None, None))
    found = {r.doc_id: r for r in px.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert not found[900].kept and not found[900].base_failed and found[901].perplexity is None
    assert all(found[i].kept for i in range(150))
    low = px.judge(spark.createDataFrame([(False, "en", 1.5)], "base_failed boolean, lm_lang string, perplexity double"), {"en": (2.0, 9.0)})
    assert not low.first().kept


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert px.quality(empty).count() == 0
    rows = spark.createDataFrame([(1, "ab", "x"), (1, "ab", "x"), (None, "a" * 2_000_000, None)], empty.schema).withColumns({c: F.lit(1) for c in ("n", "gram", "slot")})
    found = px.quality(rows).collect()
    assert len(found) == 3 and sum(r.perplexity is None for r in found) == 2
