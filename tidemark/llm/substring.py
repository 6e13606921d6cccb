"""Substring deduplication: Rabin-Karp hashes of every window of ``span`` words, counted in Spark.

Windows in a row that share one anchor (the least hash of a shorter word sequence inside the window) form a run. Equal
windows have equal anchors, so they always meet under one anchor:

1. runs are counted by the hash of all their words; a run that begins in a smaller document goes as a whole;
2. where one anchor has several different runs, the windows of all copies of a run in its first document (a section may
   be repeated there, and several rows may share the id) are counted one by one.

Nothing is skipped: copies of a run in later documents were settled in step 1, and under an anchor with one run no
window of its first document stands in an earlier one.
Counts keep the least document id of each hash, so a frequent passage is combined before it is shuffled. Repeated
windows are merged into maximal intervals, which meet the texts in a join by document; texts are compressed before such
a join deals them out. Runs, copies and windows are written once as Parquet below the checkpoint folder, since several
counts read them; each reads only the columns it needs.

Defined results: words are runs of characters other than ASCII white space; a null or empty text has none; ``kept`` is
the words left, joined by one space. Rows of one id never remove each other; a row with a null id is neither source nor
target; equal rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RollingHash, WordHashes, flat, mixed, signed, sliding_min, slices, written

SPAN = 50
ANCHOR = 16
RUNS = "anchor long, run long, doc_id long, row int, start int, n int"
INTERVALS = "array<struct<start:int,n:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only


def anchored_runs(rolling: RollingHash, values: np.ndarray, bounds: np.ndarray, span: int, anchor: int):
    """First window, number of windows, anchor and hash of all words of each run."""
    prefix = rolling.prefix(values)
    count = len(values) - span + 1
    if count <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    marks = sliding_min(rolling.windows(prefix, anchor), span - anchor + 1)[:count]
    fresh = np.ones(count, bool)
    fresh[1:] = (marks[1:] != marks[:-1]) | (owner[1:count] != owner[:count - 1])
    starts = np.flatnonzero(fresh & (owner[:count] == owner[span - 1:]))
    nexts = np.flatnonzero(fresh)
    at = np.searchsorted(nexts, starts, "right")
    ends = np.minimum(np.append(nexts, count)[at], bounds[owner[starts] + 1] - span + 1)
    last = ends - 1 + span
    whole = mixed((prefix[last] - prefix[starts]) * rolling.down[starts] + (last - starts).astype(np.uint64))
    return starts, ends - starts, marks[starts], whole


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.hash(F.col(text).cast("string")).alias("row"))


def _compressed(docs: DataFrame) -> DataFrame:
    """The same rows with the texts compressed, for the joins that deal them out by document."""
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch, texts in slices(batches):
            packed = [packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["doc_id", "packed", "row"])
    return docs.mapInArrow(compress, "doc_id long, packed binary, row int")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Few rows at a time with their words."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            yield part, [unpacker.decompress(p).split() for p in part.column(1).to_pylist()]


def _runs(docs: DataFrame, span: int, anchor: int) -> DataFrame:
    names = [field.split()[0] for field in RUNS.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = WordHashes(), RollingHash()
        for batch, texts in slices(batches):
            words, bounds = flat([words_of(t) for t in texts])
            starts, n, marks, whole = anchored_runs(rolling, known.of(words), bounds, span, anchor)
            if len(starts):
                owner = np.searchsorted(bounds, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [signed(marks), signed(whole), batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner)),
                     pa.array((starts - bounds[owner]).astype(np.int32)), pa.array(n.astype(np.int32))], names=names)
    return docs.where("doc_id IS NOT NULL").mapInArrow(scan, RUNS)


def _windows(docs: DataFrame, span: int) -> DataFrame:
    """Each window of the runs in column ``runs``: hash, doc_id, row, start."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = WordHashes(), RollingHash()
        for part, words_of_each in _unpacked(b.filter(b.column(3).is_valid()) for b in batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for doc, row, words, wanted in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), words_of_each, part.column(3).to_pylist()):
                hashes = rolling.windows(rolling.prefix(known.of(words)), span).view(np.int64)
                starts = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in wanted])
                for column, values in zip(out, (hashes[starts], np.full(len(starts), doc), np.full(len(starts), row, np.int32), starts.astype(np.int32))):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["hash", "doc_id", "row", "start"])
    return docs.mapInArrow(scan, "hash long, doc_id long, row int, start int")


def _intervals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def _cut(docs: DataFrame, span: int) -> DataFrame:
    """Words without those that the windows of ``runs`` cover."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words_of_each in _unpacked(batches):
            out: list[list] = [[], [], [], []]
            for words, runs in zip(words_of_each, batch.column(3).to_pylist()):
                spans: list[list[int]] = []
                for start, n in sorted((r["start"], r["n"]) for r in runs or ()):
                    end = start + n - 1 + span
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                kept, at = [], 0
                for start, end in spans:
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append([{"start": s, "end": e} for s, e in spans])
                out[3].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(out[3], pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed", "kept"])
    return docs.mapInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string")


def remove_repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, ``removed`` (maximal word intervals) and ``kept`` (the rest of the text)."""
    anchor = min(anchor, span)
    keyed = _keyed(docs, doc_id, text)
    runs = written(_runs(keyed, span, anchor))
    packed = _compressed(keyed)
    # equal runs have equal anchors, so a run's hash alone is its key
    firsts = runs.groupBy("run").agg(F.min(F.struct("doc_id", "row", "start", "n", "anchor")).alias("first")).select("run", "first.*")
    keys = firsts.select("run", "anchor", F.col("doc_id").alias("before"), F.col("row").alias("first_row"), F.col("start").alias("first_start"))
    # written once: both steps read these copies, the first those in later documents, the second those in the first one
    copies = written(runs.select("run", "doc_id", "row", "start", "n").join(keys, "run")
                         .where("before < doc_id OR row <> first_row OR start <> first_start")
                         .select("anchor", "doc_id", "row", "start", "n", F.expr("before < doc_id").alias("later")))
    repeated = copies.where("later").select("doc_id", "row", "start", "n")

    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1").select("anchor")
    unsettled = firsts.drop("run").unionByName(copies.where("NOT later").drop("later")).join(several, "anchor").drop("anchor")
    windows = written(_windows(packed.join(_intervals(unsettled), ["doc_id", "row"]).select("doc_id", "packed", "row", "runs"), span))
    least = windows.groupBy("hash").agg(F.min("doc_id").alias("before"))
    alone = windows.join(least, "hash").where("before < doc_id").select("doc_id", "row", "start", F.lit(1).alias("n"))

    gone = _intervals(repeated.unionByName(alone))
    return _cut(packed.join(gone, ["doc_id", "row"], "left").select("doc_id", "packed", "row", "runs"), span)


ORACLE = rf"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
places AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {SPAN - 1}], ' ')) AS k FROM (
  SELECT doc_id, w, unnest(range(1, CAST(len(w) - {SPAN} + 2 AS BIGINT))) AS i FROM docs WHERE len(w) >= {SPAN})),
firsts AS (SELECT k, min(doc_id) AS before FROM places GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SPAN})) AS p FROM (SELECT doc_id, i FROM places JOIN firsts ON places.k = firsts.k WHERE before < doc_id)),
listed AS (SELECT doc_id, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS p, unnest(w) AS word FROM docs),
kept AS (SELECT listed.doc_id, string_agg(word, ' ' ORDER BY listed.p) AS text FROM listed LEFT JOIN gone ON listed.doc_id = gone.doc_id AND listed.p = gone.p
  WHERE gone.p IS NULL GROUP BY listed.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id
"""
