"""Ranked lexical search with bag deduplication.

A document matters to a query set only by how often each term of that set occurs in it and by its length norm m. So each
document becomes a bag (term numbers of the query vocabulary with their counts, nothing else), and documents with the
same bag and the same m form a class: grouped by a 64-bit hash, verified by the bag itself. Document frequencies are
counted and scores computed once per class in sparse numpy batches, however many members it has. Any of the ten best
documents lies in one of the ten classes that are best by (score, least member id), so only these are expanded, by
ascending document id.

The query set is worked off in blocks of about ``BLOCK_TERMS`` term entries; a block's vocabulary and weights are all that
is broadcast, so their size does not depend on the documents, and on the query set only through one item's own size.

Defined results: A-Z is lower-cased, terms are runs of digits, letters a-z and characters beyond ASCII. A null or empty
text has no term: such a document is not counted in N and never returned, such an item returns nothing. Rows with the same
item id and text are one item, an id with several texts is ranked for each of them. Equal document rows are documents of
their own; null document ids come after all others. Other columns of the inputs are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, written
from tidemark.llm.winnowing import words_of

TOP = 10
BLOCK_TERMS = 1_000_000
#: Score cells (classes x items) that a task holds at once.
CELLS = 4_000_000
KNOWN_WORDS = 300_000
RESULT = "item_id long, rank int, doc_id long, score long"


class TermNumbers(dict):
    """Numbers of words in a sorted array of 64-bit word hashes, -1 for all others; a bounded number is remembered."""

    def __init__(self, hashes: np.ndarray) -> None:
        super().__init__()
        self.hashes = hashes

    def __missing__(self, word: bytes) -> int:
        value = np.uint64(xxhash.xxh3_64_intdigest(word))
        at = int(np.searchsorted(self.hashes, value))
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = at if at < len(self.hashes) and self.hashes[at] == value else -1
        return found


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, digest of the text, term hash and repeats, for each distinct term of each distinct (id, text)."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            rows: list[tuple] = []
            for item, value in zip(batch.column(0).to_pylist(), texts):
                words = words_of(value)
                digest = xxhash.xxh3_64_intdigest((value or "").encode("utf-8", "surrogatepass")) - (1 << 63)
                hashes, repeats = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), return_counts=True)
                rows += [(item, digest, h, r) for h, r in zip(hashes.view(np.int64).tolist(), repeats.tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item_id", "digest", "term", "repeats"])
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(terms, "item_id long, digest long, term long, repeats long").distinct()


def encode_bag(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Width of the counts, then term numbers, then counts: equal bags are equal bytes."""
    width = "<u1" if counts.max(initial=0) < 256 else "<u4"
    return bytes([int(width[2])]) + numbers.astype("<u4").tobytes() + counts.astype(width).tobytes()


def decode_bags(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term number and count of all entries of some bags."""
    sizes = [(len(b) - 1) // (4 + b[0]) for b in bags]
    numbers = np.frombuffer(b"".join(b[1:1 + 4 * n] for b, n in zip(bags, sizes)), "<u4")
    counts = [np.frombuffer(b, f"<u{b[0]}", n, 1 + 4 * n) for b, n in zip(bags, sizes)]
    return np.repeat(np.arange(len(bags)), sizes), numbers.astype(np.int64), np.concatenate(counts).astype(np.int64)


def document_bags(docs: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (all terms of the document), bag and its hash ``digest``; the bag of a document without a query term is null."""
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TermNumbers(vocabulary.value)
        span = len(numbers.hashes) + 1
        for batch, texts in slices(batches):
            words = [words_of(t) for t in texts]
            lengths = np.array([len(w) for w in words], np.int64)
            found = np.fromiter((n for w in words for n in map(numbers.__getitem__, w)), np.int64, int(lengths.sum()))
            owner = np.repeat(np.arange(len(texts)), lengths)[found >= 0]
            keys, counts = np.unique(owner * span + found[found >= 0], return_counts=True)
            bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
            terms = keys % span
            out = [encode_bag(terms[a:b], counts[a:b]) if b > a else None for a, b in zip(bounds, bounds[1:])]
            digests = [None if b is None else xxhash.xxh3_64_intdigest(b) - (1 << 63) for b in out]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lengths), pa.array(digests, pa.int64()), pa.array(out, pa.binary())],
                                             names=["doc_id", "n", "digest", "bag"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(bags, "doc_id long, n long, digest long, bag binary")


def document_frequencies(classes: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary: summed per task, then by Spark; ``size`` numbers reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            owner, numbers, _ = decode_bags(batch.column(1).to_pylist())
            np.add.at(total, numbers, batch.column(0).to_numpy()[owner])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])
    found = classes.select("size", "bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return out


class Best:
    """The ``top`` best classes of one item: highest score, then least member id (a null id is the largest)."""

    def __init__(self, top: int) -> None:
        self.top, self.rows, self.least = top, [], 1

    def add(self, scores: np.ndarray, firsts: np.ndarray, bags: list[bytes], norms: np.ndarray, digests: np.ndarray) -> None:
        found = np.flatnonzero(scores >= self.least)
        if len(found) > self.top:
            found = found[np.lexsort((firsts[found], -scores[found]))[:self.top]]
        self.rows += [(int(scores[i]), int(firsts[i]), int(norms[i]), int(digests[i]), bags[i]) for i in found]
        self.rows.sort(key=lambda r: (-r[0], r[1]))
        del self.rows[self.top:]
        if len(self.rows) == self.top:
            self.least = max(1, self.rows[-1][0])


def best_classes(classes: DataFrame, model, top: int) -> DataFrame:
    """Per task and item the best classes; ``model`` holds for each term number its items and weights times repeats."""
    last = np.iinfo(np.int64).max

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, owners, weights, n_items = model.value
        best = [Best(top) for _ in range(n_items)]
        step = max(1, CELLS // n_items)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                norms, digests = part.column(0).to_numpy(), part.column(2).to_numpy()
                firsts, bags = part.column(1).fill_null(last).to_numpy(), part.column(3).to_pylist()
                owner, numbers, tf = decode_bags(bags)
                worth = (1_000_000_000 * tf) // (1000 * tf + 8 * norms[owner])
                cells = np.zeros(n_items * len(bags), np.int64)
                fan = starts[numbers + 1] - starts[numbers]
                ends = np.cumsum(fan)
                # entries of all bags, each with the items of its term, in slices of bounded size
                cut = np.searchsorted(ends, np.arange(0, int(ends[-1]), CELLS)) if len(ends) else []
                for a, b in zip(cut, [*cut[1:], len(ends)]):
                    own = fan[a:b]
                    entry = np.repeat(np.arange(a, b), own)
                    slot = np.arange(len(entry)) - np.repeat(np.cumsum(own) - own, own) + starts[numbers[entry]]
                    np.add.at(cells, owners[slot] * len(bags) + owner[entry], weights[slot] * worth[entry])
                table = cells.reshape(n_items, len(bags))
                for item in np.flatnonzero(table.max(axis=1) >= np.array([b.least for b in best])):
                    best[item].add(table[item], firsts, bags, norms, digests)
        rows = [(item, *row) for item, own in enumerate(best) for row in own.rows]
        if rows:
            columns = list(zip(*rows))
            columns[2] = [None if f == last else f for f in columns[2]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(columns)],
                                             names=["item", "score", "first", "m", "digest", "bag"])
    return classes.select("m", "first", "digest", "bag").mapInArrow(score, "item long, score long, first long, m long, digest long, bag binary")


def _ranked(rows: DataFrame, by: list[str], order: list, top: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= top)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           top: int = TOP, k1_share: int = 75, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score. ``k1_share`` percent of the norm follow the length."""
    spark = docs.sparkSession
    terms = written(item_terms(items, item_id, item_text))
    blocks = -(-terms.count() // block_terms)
    terms = terms.withColumn("block", F.expr(f"pmod(xxhash64(item_id, digest), {max(1, blocks)}L)"))
    terms = terms.withColumn("item_id", F.col("item_id").cast("string"))    # null ids would turn whole numbers into doubles
    results = [_search_block(docs, terms.where(F.col("block") == b).toPandas(), doc_id, text, top, k1_share) for b in range(blocks)]
    results = [r for r in results if r is not None]
    return reduce(DataFrame.unionAll, results) if results else spark.createDataFrame([], RESULT)


def _search_block(docs: DataFrame, entries, doc_id: str, text: str, top: int, k1_share: int) -> DataFrame | None:
    if not len(entries):
        return None
    spark = docs.sparkSession
    vocabulary, number = np.unique(entries["term"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    item = entries.groupby(["item_id", "digest"], dropna=False, sort=True).ngroup().to_numpy(np.int64)
    ids = [int(x) if isinstance(x, str) else None for x in entries["item_id"].to_numpy(object)[np.unique(item, return_index=True)[1]]]
    bags = written(document_bags(docs, spark.sparkContext.broadcast(vocabulary), doc_id, text))
    total = bags.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not total.terms:
        return None
    held = bags.where("bag IS NOT NULL").withColumn("m", F.expr(f"{100 - k1_share}L + ({k1_share}L * n * {total.docs}L) div {total.terms}L"))
    classes = written(held.groupBy("digest", "m", "bag").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")))
    df = document_frequencies(classes, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    order = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[order], np.arange(len(vocabulary) + 1))
    weights = weight[number[order]] * entries["repeats"].to_numpy(np.int64)[order]
    model = spark.sparkContext.broadcast((starts, item[order], weights, len(ids)))
    best = _ranked(best_classes(classes, model, top), ["item"], [F.desc("score"), F.asc_nulls_last("first")], top, "place")
    best = written(best.drop("place", "first"))    # at most ``top`` classes an item
    key = ["digest", "m", "bag"]
    # a class may hold any share of the documents: its least ids are picked per task first, before the join and its shuffle
    members = _ranked(held.select("doc_id", *key), key, [F.asc_nulls_last("doc_id")], top, "place")
    found = _ranked(members.drop("place").join(best, key), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], top, "rank")
    names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
    return found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS_SQL.format('text')}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs, totals GROUP BY term),
wanted AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS_SQL.format('text')}) AS term FROM benchmark) AS q GROUP BY item_id, term),
norms AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM sizes, totals),
scores AS (SELECT item_id, t.doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tfs AS t USING (term) JOIN norms ON norms.doc_id = t.doc_id GROUP BY item_id, t.doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
