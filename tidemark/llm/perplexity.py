"""Quality rules and n-gram perplexity with language-specific bands.

The model is modified Kneser-Ney over characters, one per language. Spark counts the ``ORDER``-grams of all texts; an
n-gram is its symbols packed into one integer, so contexts and suffixes are shifts and masks, and all lower orders
(continuation counts) and discounts come from that one table by grouping. Numerators and context sums are kept by language
and packed n-gram, so none shares an entry with another, and their number grows with the corpus. They are broadcast in
shards by hash of the n-gram, each a sorted array looked up by binary search: the driver holds one shard at a time, and
a worker too once the model is larger than ``HELD_BYTES``.

Each text is scored whole; its perplexity is per word, so that symbols stuck to words or standing for words show as well as
unlikely letters do. The band of a language lies around the quartiles of the log perplexity of all its documents
that pass the base rules; perplexities below it (repetition, templates) or above it (noise, other languages) reject.

Defined results: words are runs of characters other than ASCII white space; a null or empty text has none and fails the
base rules; a text shorter than ``ORDER`` characters has a null perplexity, which rejects nothing; a null language is a
language of its own; repeated rows and null ids are judged like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RollingHash, WordHashes, flat, mixed, slices
from tidemark.session import cut_lineage

ORDER = 5
SYMBOL_BITS = 12
EXACT_SYMBOLS = 0x250
SHARD_ENTRIES = 1_000_000    # of one order in one broadcast, about
HELD_BYTES = 160_000_000     # of a model that a worker keeps; a larger one is read shard by shard for each group of slices
GROUP_SLICES = 20
HELD_GRAMS = 800_000     # of a language in a task's memory before they are sent on
TEXT_SLICE = 400_000
NO_LANGUAGE = ""
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BAND_IQR = 4.0           # band: quartiles less and plus so many times their distance,
BAND_LEAST = 1.0         # and this at least (natural logarithm of the perplexity)
BINS = 200              # of the logarithm, per unit


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Code point to symbol: Latin ones are exact, digits are one, others share what is left."""
    codes = np.arange(0x110000, dtype=np.int64)
    rest = (1 << SYMBOL_BITS) - EXACT_SYMBOLS
    table = np.where(codes < EXACT_SYMBOLS, codes, EXACT_SYMBOLS + (codes * 2_654_435_761 >> 7) % rest).astype(np.uint16)
    table[48:58] = 48
    table[9:14] = 32
    return table


def packed_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All packed n-grams of the texts in order, and where each text's begin (one more entry: the end)."""
    coded = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in coded])
    symbols = _symbols()[np.concatenate(coded)].astype(np.int64) if coded else np.zeros(0, np.int64)
    whole = max(0, len(symbols) - ORDER + 1)
    keys = np.zeros(whole, np.int64)
    for k in range(ORDER):
        keys = (keys << SYMBOL_BITS) | symbols[k:k + whole]
    counts = np.maximum(0, sizes - ORDER + 1)
    bounds = np.r_[0, np.cumsum(counts)]
    starts = np.r_[0, np.cumsum(sizes)][:-1]
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], counts)
    return keys[at], bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task by language, combined before they are sent."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def combined(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held[lang]))
        distinct, place = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(place, counts, len(distinct)).astype(np.int64)

    def sent(lang: str) -> pa.RecordBatch:
        keys, counts = combined(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    for batch, texts in slices(batches, limit=TEXT_SLICE):
        langs = batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            keys, _ = packed_grams([t for t, own in zip(texts, langs) if own == lang])
            held.setdefault(lang, []).append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held[lang]) > HELD_GRAMS:
                held[lang] = [combined(lang)]
                if 2 * len(held[lang][0][0]) > HELD_GRAMS:
                    yield sent(lang)
                    del held[lang]
    for lang in held:
        yield sent(lang)


@dataclass(frozen=True)
class Perplexity:
    """Per order the shards, each by language the sorted keys and values: numerators of n-grams, totals and back-off sums of contexts."""

    grams: list[list[Broadcast]]
    contexts: list[list[Broadcast]]
    held: bool


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(keys.astype(np.uint64)) >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _shards(rows: DataFrame, shards: int) -> tuple[list[Broadcast], int]:
    """Rows (lang, gram, value...) as broadcasts, and their bytes."""
    values = rows.columns[2:]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, langs = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            keys, numbers = batch.column(1).to_numpy(), [batch.column(i).to_numpy().astype(np.float32) for i in range(2, batch.num_columns)]
            home = langs.astype(np.int64) * shards + shard_of(keys, shards)
            out: list[list] = [[] for _ in range(3 + len(values))]
            for own in np.unique(home):
                at = home == own
                for column, value in zip(out, (names[own // shards], int(own % shards), *(x[at].tobytes() for x in (keys, *numbers)))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.binary()) for c in out[2:])],
                                             names=["lang", "shard", "gram", *values])
    packed = rows.mapInArrow(pack, ", ".join(["lang string, shard int, gram binary", *(f"{v} binary" for v in values)]))
    if shards > 1:
        packed = cut_lineage(packed)
    out, size = [], 0
    for number in range(shards):
        pieces: dict[str, list] = {}
        for lang, _, *arrays in packed.where(F.col("shard") == number).collect():
            pieces.setdefault(lang, []).append(arrays)
        table = {}
        for lang in list(pieces):
            keys, *numbers = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*pieces.pop(lang)), [np.int64] + [np.float32] * len(values)))
            ranked = np.argsort(keys)
            table[lang] = (keys[ranked], *(x[ranked] for x in numbers))
            size += sum(x.nbytes for x in table[lang])
        out.append(rows.sparkSession.sparkContext.broadcast(table))
    return out, size


def _discount(count: Column, discounts: dict[str, tuple[float, float, float]]) -> Column:
    """Modified Kneser-Ney discount of a count, by language."""
    out = F.lit(0.0)
    for lang, (one, two, more) in discounts.items():
        out = F.when(F.col("lang") == lang, F.when(count == 1, one).when(count == 2, two).otherwise(more)).otherwise(out)
    return out


def discounts_of(order: int, ones: float, twos: float, threes: float, fours: float) -> tuple[float, float, float]:
    """D1, D2, D3+ from counts of counts; fixed shares of the count where they are too few to tell.

    Above order 1 a count of one is discounted whole: scored texts are counted ones, and what was seen once may have
    been seen only there. Its mass goes to the shorter n-grams.
    """
    raw = (0.5, 0.75, 1.0)
    if min(ones, twos, threes, fours) > 0:
        y = ones / (ones + 2 * twos)
        raw = (1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes)
    one, two, more = (min(max(d, 0.05), k) for d, k in zip(raw, (0.95, 1.9, 2.8)))
    return (one if order == 1 else 1.0), two, more


def fit_perplexity(docs: DataFrame, text: str = "text", lang: str = "lang") -> Perplexity:
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang")).where("text IS NOT NULL")
    table = cut_lineage(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    grams, contexts, size = [], [], 0
    for order in range(ORDER, 0, -1):
        found = table.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)],
                                           F.count(F.lit(1)).alias("entries")).collect()
        shards = max(1, -(-sum(r["entries"] for r in found) // SHARD_ENTRIES))
        discounts = {r["lang"]: discounts_of(order, r["n1"], r["n2"], r["n3"], r["n4"]) for r in found}
        taken = table.withColumn("less", _discount(F.col("n"), discounts))
        # what has no numerator, and what leaves all to the shorter n-grams, changes no probability and is not stored
        own, own_size = _shards(taken.select("lang", "gram", (F.col("n") - F.col("less")).alias("num")).where("num > 0"), shards)
        around, around_size = _shards(taken.groupBy("lang", F.shiftright("gram", SYMBOL_BITS).alias("gram")).agg(
            F.sum("n").cast("double").alias("total"), F.sum("less").alias("less")).where("less < total"), shards)
        grams.insert(0, own)
        contexts.insert(0, around)
        size += own_size + around_size
        if order > 1:      # continuation counts: how many symbols stand before the suffix
            table = cut_lineage(table.groupBy("lang", F.col("gram").bitwiseAND((1 << SYMBOL_BITS * (order - 1)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    return Perplexity(grams, contexts, size <= HELD_BYTES)


def _lookup(shards: list[Broadcast], wanted: dict[str, np.ndarray], values: int, held: bool) -> dict[str, list[np.ndarray]]:
    """Values at the wanted keys of each language, 0 where there is none."""
    found = {lang: [np.zeros(len(keys)) for _ in range(values)] for lang, keys in wanted.items()}
    homes = {lang: shard_of(keys, len(shards)) for lang, keys in wanted.items()}
    for number, shard in enumerate(shards):
        tables = shard.value
        for lang, keys in wanted.items():
            if lang not in tables:
                continue
            own = np.flatnonzero(homes[lang] == number)
            known, *numbers = tables[lang]
            at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
            hit = known[at] == keys[own]
            for out, x in zip(found[lang], numbers):
                out[own] = np.where(hit, x[at], 0.0)
        del tables
        if not held and getattr(shard, "_path", None):     # the copy in memory; the file stays
            vars(shard).pop("_value", None)
    return found


def log_probabilities_of(model: Perplexity, wanted: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Natural logarithm of the interpolated probability of each packed n-gram's last symbol, by language."""
    p = {lang: np.full(len(keys), 2.0 ** -SYMBOL_BITS) for lang, keys in wanted.items()}
    for order in range(1, ORDER + 1):
        suffix = {lang: keys & ((1 << SYMBOL_BITS * order) - 1) for lang, keys in wanted.items()}
        nums = _lookup(model.grams[order - 1], suffix, 1, model.held)
        around = _lookup(model.contexts[order - 1], {lang: keys >> SYMBOL_BITS for lang, keys in suffix.items()}, 2, model.held)
        for lang, (total, less) in around.items():
            seen = total > 0
            p[lang] = np.where(seen, (nums[lang][0] + less * p[lang]) / np.where(seen, total, 1.0), p[lang])
    return {lang: np.log(x) for lang, x in p.items()}


def log_probabilities(model: Perplexity, keys: np.ndarray, lang: str) -> np.ndarray:
    return log_probabilities_of(model, {lang: keys})[lang]


def base_counts(texts: list[str | None], known: WordHashes, rolling: RollingHash) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    joined, bounds = flat(words)
    triples = rolling.windows(rolling.prefix(known.of(joined)), 3)
    out = np.zeros((len(texts), 5), np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        n = len(words[i])
        lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
        repeated = 0
        if n > 3:
            own = triples[bounds[i]:bounds[i + 1] - 2]
            ranked = np.argsort(own, kind="stable")
            equal = own[ranked][1:] == own[ranked][:-1]
            twice = np.zeros(n - 2, bool)
            twice[ranked[1:][equal]] = True
            twice[ranked[:-1][equal]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k:n - 2 + k] |= twice
            repeated = int(covered.sum())
        out[i] = (n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated)
    return out


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score_documents(docs: DataFrame, model: Perplexity, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with the base counts, ``base_failed``, ``lm_lang`` and ``perplexity``."""
    names = list(docs.columns if keep is None else keep)

    def judged(group: list[tuple[pa.RecordBatch, np.ndarray, list]]) -> Iterator[pa.RecordBatch]:
        wanted: dict[str, list[np.ndarray]] = {}
        for _, _, parts in group:
            for own, _, distinct, _, _ in parts:
                wanted.setdefault(own, []).append(distinct)
        keys = {own: x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for own, x in wanted.items()}
        logs = log_probabilities_of(model, keys)
        for batch, base, parts in group:
            result: list[float | None] = [None] * batch.num_rows
            for own, rows, distinct, place, bounds in parts:
                sums = np.r_[0.0, np.cumsum(logs[own][np.searchsorted(keys[own], distinct)][place])]
                for i, a, b in zip(rows, bounds[:-1], bounds[1:]):
                    if b > a and base[i, 0]:
                        result[i] = float(np.exp(min(700.0, (sums[a] - sums[b]) / base[i, 0])))
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed),
                 batch.column(len(names) + 1), pa.array(result, pa.float64())],
                names=[*batch.schema.names[:len(names)], *BASE, "base_failed", "lm_lang", "perplexity"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = WordHashes(80_000), RollingHash()
        group: list[tuple[pa.RecordBatch, np.ndarray, list]] = []
        for batch, texts in slices(batches, "__text", TEXT_SLICE):
            langs, parts = batch.column(len(names) + 1).to_pylist(), []
            for own in dict.fromkeys(langs):
                rows = [i for i, x in enumerate(langs) if x == own]
                keys, bounds = packed_grams([texts[i] for i in rows])
                if len(keys):
                    distinct, place = np.unique(keys, return_inverse=True)
                    parts.append((own, rows, distinct, place.astype(np.int32), bounds))
            group.append((batch, base_counts(texts, known, rolling), parts))
            if model.held or len(group) == GROUP_SLICES:
                yield from judged(group)
                group = []
        yield from judged(group)

    schema = docs.select(*names).schema
    for name in BASE:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("lm_lang", "string").add("perplexity", "double")
    rows = docs.select(*names, F.col(text).alias("__text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("__lang"))
    return rows.mapInArrow(score, schema)


def perplexity_bands(scored: DataFrame) -> dict[str, tuple[float, float]]:
    """Lower and upper perplexity of each language, from a histogram of fixed width over all documents that pass the base rules."""
    bins = (scored.where("NOT base_failed AND perplexity IS NOT NULL")
            .groupBy("lm_lang", F.floor(F.log("perplexity") * BINS).cast("int").alias("bin")).count().toPandas())
    bands = {}
    for lang, own in bins.groupby("lm_lang"):
        own = own.sort_values("bin")
        share = own["count"].cumsum() / own["count"].sum()
        low, high = (float(own["bin"][share >= q].iloc[0]) / BINS for q in (0.25, 0.75))
        width = max(BAND_LEAST, BAND_IQR * (high - low))
        bands[lang] = (float(np.exp(low - width)), float(np.exp(high + width)))
    return bands


def judge(scored: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds ``kept``: base rules passed and perplexity, if any, inside the band of the language."""
    inside = F.lit(True)
    for lang, (low, high) in bands.items():
        inside = F.when(F.col("lm_lang") == lang, F.coalesce(F.col("perplexity").between(low, high), F.lit(True))).otherwise(inside)
    return scored.withColumn("kept", ~F.col("base_failed") & inside)


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Fit on the documents, score and judge them."""
    scored = cut_lineage(score_documents(docs, fit_perplexity(docs, text, lang), text, lang, keep))
    return judge(scored, perplexity_bands(scored))
