"""Language identification: multinomial naive Bayes over hashed character n-grams.

Spark counts the n-grams of every labelled text by language; the log-probability matrix (languages x buckets, a
fixed number of buckets) is broadcast, and batches are scored sparsely in numpy: each n-gram looks up one column.

Defined results: a null text or one without a letter has ``lang_pred`` ``und`` and score 0; rows without a label teach
nothing; an empty training table gives ``und`` everywhere; repeated rows and null ids are scored like any other row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

UNKNOWN = "und"
BUCKET_BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_probs: np.ndarray      # float32, one row per bucket, one column per language
    log_priors: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to itself for letters and marks, to a space for all else; beyond the table to itself."""
    table = np.arange(0x30000, dtype=np.uint32)
    keep = np.fromiter((LETTER.match(chr(c)) is not None or chr(c) == "'" for c in range(0x30000)), bool, 0x30000)
    table[~keep] = 32
    return table


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and how many each text has: texts are apart, so that no n-gram crosses."""
    table = _letters()
    coded = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    bounds = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(c) for c in coded], out=bounds[1:])
    codes = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
    codes = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    buckets, owners = [], []
    value = np.zeros(len(codes), np.uint32)
    shift = np.uint32(32 - BUCKET_BITS)
    for n in range(1, max(ORDERS) + 1):
        whole = max(0, len(codes) - n + 1)
        value = value[:whole] * np.uint32(0x01000193) + (codes[n - 1:] + np.uint32(1)) * np.uint32(0x85EBCA6B)
        if n in ORDERS:
            # one text only, and not a mere space
            keep = (owner[:whole] == owner[n - 1:]) & ((codes[:whole] != 32) | (codes[n - 1:] != 32))
            mixed = (value[keep] ^ (value[keep] >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
            buckets.append(mixed >> shift)
            owners.append(owner[:whole][keep])
    return np.concatenate(buckets), np.concatenate(owners)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    texts_of: dict[str, int] = {}
    for batch, texts in slices(batches):
        names = batch.column(batch.schema.names.index("label")).to_pylist()
        known = {name: i for i, name in enumerate(dict.fromkeys(names))}
        buckets, owners = _grams(texts)
        codes = np.array([known[name] for name in names], np.int64)[owners]
        found = np.bincount((codes << BUCKET_BITS) | buckets, minlength=len(known) << BUCKET_BITS).reshape(len(known), -1)
        for name, i in known.items():
            sums[name] = sums.get(name, 0) + found[i]
            texts_of[name] = texts_of.get(name, 0) + names.count(name)
    for name, counted in sums.items():
        hit = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * (len(hit) + 1), pa.string()), pa.array(np.r_[-1, hit].astype(np.int32)),
             pa.array(np.r_[texts_of[name], counted[hit]].astype(np.int64))], names=["label", "bucket", "n"])


def fit_language_model(docs: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """Fit on all rows with a label and a text. What reaches the driver has a fixed size: labels x buckets."""
    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("label IS NOT NULL AND text IS NOT NULL")
    counted = (rows.mapInArrow(_counts, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
               .toPandas())
    languages = sorted(counted["label"].unique())
    sums = np.zeros((len(languages), (1 << BUCKET_BITS) + 1))
    sums[[languages.index(x) for x in counted["label"]], counted["bucket"]] = counted["n"]
    texts, grams = sums[:, -1], sums[:, :-1] + SMOOTHING
    log_probs = np.log(grams / grams.sum(axis=1, keepdims=True))
    return LanguageModel(languages, np.ascontiguousarray(log_probs.T, np.float32), np.log(texts / max(1, texts.sum())) if languages else texts)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text."""
    has_letter = np.fromiter((t is not None and LETTER.search(t) is not None for t in texts), bool, len(texts))
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    buckets, owners = _grams(texts)
    logs = np.column_stack([np.bincount(owners, model.log_probs[buckets, k], len(texts)) for k in range(len(model.languages))])
    logs = logs + model.log_priors
    best = logs.argmax(axis=1)
    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)], np.where(has_letter, share, 0.0)


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None,
                      results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (all by default) with the two ``results``, which take the place of columns of those names; no shuffle."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    read = "__text"
    while read in names:
        read += "_"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, read):
            predicted, share = score_texts(shared.value, texts)
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(predicted, pa.string()), pa.array(share)],
                                             names=[*names, *results])

    rows = docs.select(*names, F.col(text).alias(read))
    schema = docs.select(*names).schema.add(results[0], "string").add(results[1], "double")
    return rows.mapInArrow(score, schema)
