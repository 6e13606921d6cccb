"""Benchmark decontamination by winnowing.

A fingerprint is the least hash of the ``gram``-word sequences inside a window of ``span`` words; two equal windows have
equal fingerprints, so the join of fingerprints finds every shared window. Windows in a row with one fingerprint travel
together with their Rabin-Karp hashes, and a hit is extended to those of them that an item of the test set has too.

The fingerprints of the test items are folded into a bitmap of a fixed number of bits, the only thing that is broadcast;
documents send on the windows whose fingerprint meets it. A crowded bitmap lets more rows through, never fewer, and the
join that follows is an ordinary one. Texts never move.

Defined results: A-Z is lower-cased, words are runs of digits, a-z and characters beyond ASCII. An item with fewer than
``span`` words, but not none, is one window; items without words match nothing. A null text has no words. Rows with the
same id and text are one document, rows with the same id and other texts are documents of their own. A null id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RollingHash, WordHashes, flat, signed, sliding_min, slices

SPAN = 13
GRAM = 5
BITMAP_BITS = 22
ALPHABET = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
ROWS = "doc_id long, digest long, n_words long, span int, fingerprint long, start int, hashes array<long>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ALPHABET).split()


def fingerprints(rolling: RollingHash, prefix: np.ndarray, bounds: np.ndarray, span: int, gram: int):
    """Runs of windows with one fingerprint: (first window of each run, end, fingerprint), and the hashes of all windows.

    ``bounds`` tells where texts begin; windows lie inside one text. With ``gram`` equal to ``span`` each window is a run.
    """
    hashes = rolling.windows(prefix, span)
    count = len(hashes)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), hashes
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = owner[:count] == owner[span - 1:]
    marks = hashes if gram == span else sliding_min(rolling.windows(prefix, gram), span - gram + 1)[:count]
    fresh = np.ones(count, bool)
    if gram != span:
        fresh[1:] = (marks[1:] != marks[:-1]) | (owner[1:count] != owner[:count - 1])
    fresh &= whole
    starts = np.flatnonzero(fresh)
    # a run ends where the next one begins or where windows would leave the text
    ends = np.minimum(np.append(starts[1:], count), bounds[owner[starts] + 1] - span + 1)
    return starts, ends, marks[starts], hashes


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """All windows of the test items: item_id (as text), span, fingerprint, hash."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = WordHashes(), RollingHash()
        for batch, texts in slices(batches):
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for item, value in zip(ids, texts):
                words = words_of(value)
                if not words:
                    continue
                size = min(span, len(words))
                prefix = rolling.prefix(known.of(words))
                starts, ends, marks, hashes = fingerprints(rolling, prefix, np.array([0, len(words)]), size, gram if size == span else size)
                for s, e, m in zip(starts, ends, marks.view(np.int64)):
                    rows += [(item, size, int(m), int(h)) for h in hashes[s:e].view(np.int64)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                                 names=["item_id", "span", "fingerprint", "hash"])

    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(windows, "item_id string, span int, fingerprint long, hash long").distinct()


def _bit(column: Column) -> Column:
    return column.bitwiseAND((1 << BITMAP_BITS) - 1)


def find_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
              item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per document: n_words, and the shared windows ``hits`` (start, span) with the ids of their items ``items``, both sorted."""
    windows = item_windows(items, item_id, item_text, span, gram).persist()
    # at most 2**BITMAP_BITS bits and ``span`` lengths, whatever the size of the test set
    bits = windows.select(_bit(F.col("fingerprint")).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()
    sizes = sorted(row.span for row in windows.select("span").distinct().collect())
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[bits] = True
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(bitmap, bitorder="little"), sizes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = WordHashes(), RollingHash()
        packed, lengths = shared.value
        for batch, texts in slices(batches):
            words, bounds = flat([words_of(t) for t in texts])
            prefix = rolling.prefix(known.of(words))
            ids = batch.column(0).cast(pa.int64())
            digests = pa.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts], pa.int64())
            # a document's own row: span 0 and its digest instead of a fingerprint match nothing and spread evenly
            yield pa.RecordBatch.from_arrays(
                [ids, digests, pa.array(np.diff(bounds)), pa.array(np.zeros(len(texts), np.int32)), digests,
                 pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.list_(pa.int64()))], names=NAMES)
            for size in lengths:
                starts, ends, marks, hashes = fingerprints(rolling, prefix, bounds, size, gram if size == span else size)
                low = (marks & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
                hit = np.flatnonzero((packed[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                starts, ends, marks = starts[hit], ends[hit], marks[hit]
                owner = np.searchsorted(bounds, starts, "right") - 1
                runs = np.zeros(len(hit) + 1, np.int32)
                np.cumsum(ends - starts, out=runs[1:])
                inside = np.arange(runs[-1]) + np.repeat(starts - runs[:-1], ends - starts)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), digests.take(pa.array(owner)), pa.nulls(len(hit), pa.int64()),
                     pa.array(np.full(len(hit), size, np.int32)), signed(marks), pa.array((starts - bounds[owner]).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(runs), signed(hashes[inside]))], names=NAMES)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, ROWS)
    prints = windows.select("span", "fingerprint").distinct()
    # one pass over the texts: rows of documents (no fingerprint) and rows of windows go on side by side
    met = rows.join(prints.withColumn("met", F.lit(True)), ["span", "fingerprint"], "left").where("n_words IS NOT NULL OR met")
    extended = (met.select("doc_id", "digest", "n_words", "span", "start", F.posexplode_outer("hashes").alias("step", "hash"))
                .withColumn("hash", F.coalesce("hash", "digest"))
                .join(windows.select("span", "hash", "item_id").distinct(), ["span", "hash"], "left")
                .where("n_words IS NOT NULL OR item_id IS NOT NULL"))
    place = F.when(F.col("item_id").isNotNull(), F.struct((F.col("start") + F.col("step")).alias("start"), "span"))
    return extended.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(place)).alias("hits"),
        F.sort_array(F.collect_set("item_id")).alias("items"))


NAMES = [field.split()[0] for field in ROWS.split(", ")]


def covered(hits: Column) -> Column:
    """Number of words inside sorted windows (start, span)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def step(state: Column, hit: Column) -> Column:
        end = hit["start"] + hit["span"]
        fresh = F.greatest(F.lit(0), end - F.greatest(hit["start"], state["end"]))
        return F.struct(F.greatest(end, state["end"]).alias("end"), (state["total"] + fresh).alias("total"))
    return F.aggregate(hits, start, step, lambda state: state["total"])


def contamination(docs: DataFrame, items: DataFrame, share: float = 0.05, **names: str) -> DataFrame:
    """``find_hits`` with n_hit, n_items and ``contaminated``: at least ``share`` of the words are hit."""
    hits = find_hits(docs, items, **names).withColumn("n_hit", covered(F.col("hits")))
    return hits.withColumns({
        "n_items": F.size("items").cast("long"),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * F.lit(share).cast("decimal(10,6)"))})


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without the contaminated ones; rows with a null id stay."""
    bad = contamination(docs, items, doc_id=doc_id).where("contaminated AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs[doc_id] == bad["__bad"], "left_anti")


_WORDS_SQL = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
ORACLE = f"""
WITH docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
items AS (SELECT item_id, w, least({SPAN}, len(w)) AS n FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark)),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items WHERE n > 0)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT doc_id, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM docs, (SELECT DISTINCT n FROM windows) AS sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, places.n AS n, item_id FROM places JOIN windows ON places.n = windows.n AND places.k = windows.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
"""
