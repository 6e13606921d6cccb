"""Toxicity by compression distance: what a dictionary of toxic text saves over one of ordinary text.

Two zstandard dictionaries are trained on labelled texts: one on ordinary text, one on the passages that set toxic texts
apart (byte sequences that a larger share of toxic than of ordinary texts has). Each window of ``WINDOW_WORDS`` words is
compressed with the ordinary dictionary and with both; the bytes that the toxic one saves, over all windows of a whole
text, are turned into a probability by thresholds calibrated on labelled texts that trained no dictionary.

Only the fit reads a sample: at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_ORDINARY`` ordinary labelled texts, the first by a
hash of their ids. Every text is scored whole, by one map without a shuffle.

Defined results: null and empty texts have no window and get the score of a text without savings; rows with null labels
teach nothing; without both classes every score is 0; repeated rows and null ids are scored like any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

SAMPLE_TOXIC = 1500
SAMPLE_ORDINARY = 3000
WINDOW_WORDS = 8
LEVEL = 12
ORDINARY_BYTES = 16_384
TOXIC_BYTES = 4096
GRAM = 5
MIN_TEXTS = 4        # toxic texts that have a telling sequence
MIN_RATIO = 10       # of its share in toxic texts, less two standard errors, to its share in ordinary texts


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def windows_of(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(words[i:i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=False, write_content_size=False, write_dict_id=False)


def _grams(text: str) -> set[bytes]:
    whole = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) + b" "
    return {g for g in (whole[i:i + GRAM] for i in range(len(whole) - GRAM + 1)) if b" " not in g[1:-1]}


def train_ordinary(texts: list[str]) -> bytes:
    samples = [b"".join(w[i:i + 3]) for w in map(windows_of, texts) for i in range(0, len(w), 3)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:      # too few samples to choose from: they are the dictionary
        return b"".join(samples)[-ORDINARY_BYTES:]


def train_toxic(toxic: list[str], ordinary: list[str]) -> bytes:
    """The words or parts of words that tell toxic texts apart, the most frequent last, where matches are cheapest."""
    found = Counter(g for t in toxic for g in _grams(t))
    found = Counter({g: c for g, c in found.items() if c >= MIN_TEXTS})
    against = Counter(g for t in ordinary for g in _grams(t) & found.keys())
    telling = {g for g, c in found.items()
               if (c - 2 * c ** 0.5) / len(toxic) > MIN_RATIO * (against[g] + 0.5) / max(1, len(ordinary))}
    parts: Counter[bytes] = Counter()
    for text in toxic:
        for word in text.lower().encode("utf-8", "surrogatepass").split():
            word, at = b" " + word + b" ", 0
            while at <= len(word) - GRAM:
                end = at
                while end <= len(word) - GRAM and word[end:end + GRAM] in telling:
                    end += 1
                if end > at:
                    parts[word[at:end + GRAM - 1]] += 1
                at = end + 1
    chosen: list[bytes] = []
    for part, count in sorted(parts.items(), key=lambda x: (-x[1], x[0])):
        if count >= 2 and not any(part in c for c in chosen) and sum(map(len, chosen)) + len(part) <= TOXIC_BYTES:
            chosen.append(part)
    return b"".join(reversed(chosen))


class Savings:
    """Bytes that the toxic dictionary saves in each window of a text, and what a text's windows say together."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.plain, self.both = _compressor(model.ordinary), _compressor(model.toxic + model.ordinary)

    def features(self, text: str | None) -> list[float]:
        plain, both = self.plain.compress, self.both.compress
        saved = sorted((len(plain(w)) - len(both(w)) for w in windows_of(text)), reverse=True)
        gains = [s for s in saved if s > 0]
        top = (saved[:3] + [0, 0, 0])[:3]
        return [1.0, max(0, top[0]), max(0, top[1]), max(0, top[2]), sum(gains) / max(1, len(saved)),
                np.log1p(sum(g for g in gains if g > 2)), np.log1p(len(saved))]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def _train(rows: list[tuple[str, int]], toxic_share: float) -> ToxicityModel:
    toxic, ordinary = ([t for t, y in rows if y == k and t] for k in (1, 0))
    if len(toxic) < 2 or len(ordinary) < 2:
        return ToxicityModel()
    # two of three texts train the dictionaries, the third calibrates
    learn = [[t for i, t in enumerate(texts) if i % 3] for texts in (toxic, ordinary)]
    model = ToxicityModel(train_ordinary(learn[1]), train_toxic(*learn) or b" ")
    savings = Savings(model)
    rest = [(t, 1) for t in toxic[::3]] + [(t, 0) for t in ordinary[::3]]
    x = np.array([savings.features(t) for t, _ in rest])
    y = np.array([label for _, label in rest])
    weights = _logistic(x, y)
    # the sample holds more toxic texts than the table: between both shares, so that neither error is ignored
    here, there = y.mean() / (1 - y.mean()), toxic_share / max(1e-9, 1 - toxic_share)
    weights[0] += 0.5 * np.log(there / here)
    return ToxicityModel(model.ordinary, model.toxic, weights)


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                       sample_toxic: int = SAMPLE_TOXIC, sample_ordinary: int = SAMPLE_ORDINARY) -> ToxicityModel:
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)").distinct()
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    order = F.xxhash64("__id")
    chosen = (known.where("__y = 1").orderBy(order, "__id").limit(sample_toxic)
              .unionByName(known.where("__y = 0").orderBy(order, "__id").limit(sample_ordinary)))
    # at most the documented number of rows, so it may be broadcast
    rows = (docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
            .select("__id", "__text", "__y").collect())
    rows.sort(key=lambda r: (hash(r["__id"]), r["__text"] or ""))
    total = sum(counts.values())
    return _train([(r["__text"], r["__y"]) for r in rows], counts.get(1, 0) / max(1, total))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``score`` and ``predicted``."""
    names = list(docs.columns if keep is None else keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        savings = Savings(fitted) if len(fitted.weights) else None
        for batch, texts in slices(batches, "__text"):
            if savings:
                x = np.array([savings.features(t) for t in texts])
                p = 1 / (1 + np.exp(-np.clip(x @ fitted.weights, -30, 30)))
            else:
                p = np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=[*batch.schema.names[:len(names)], "score", "predicted"])

    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(score, schema)
