"""Exact n-gram Jaccard join: T-occurrence search with DivideSkip, and the components of its links.

1. Documents with equal shingle sets are one class, known by a hash of the set.
2. Routing. Sets of one size band are cut by token hash into more parts than two linked sets can differ in, so linked
   sets have an equal part: the part's hash is a key. Rows (key, class) are dealt and sorted by key; a stream over them
   names each group of classes by its least class, and groups with one name are searched once.
3. Search. The texts of routed classes meet in their groups; a group with many shingles is cut into blocks, and every
   two blocks meet. There an inverted index is built, and each set queries it: the longest lists are set aside, the
   others merged, and only classes that occur often enough are probed in the long lists by binary search. A class whose
   component is already joined to the query's is not probed: its links would change no component.
4. Links become components by alternating large-star and small-star rounds, joins and minima only.

No pair is lost to a cap: blocks bound memory, not results. Keys of a class are sent once per task, so exact copies do
not crowd a key; nothing is collected to the driver but counts.

Defined results: A-Z is lower-cased, words are runs of characters other than ASCII white space; fewer words than a
shingle are one shingle; a text without words has no shingle and is its own component; all rows are returned, and rows
that share an id but not their text are documents of their own; a null id links with nothing and has a null component.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RollingHash, WordHashes, flat, mixed, slices, written
from tidemark.session import cut_lineage

SHINGLE = 4
PERCENT = 85
BLOCK_SHINGLES = 400_000
MU = 0.0085          # weight of list length in DivideSkip's choice of long lists
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, size: int) -> None:
        self.size, self.known, self.rolling = size, WordHashes(), RollingHash()

    def sets(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        words, bounds = flat(texts)
        prefix = self.rolling.prefix(self.known.of(words))
        hashes = self.rolling.windows(prefix, self.size)
        out = []
        for start, end in zip(bounds[:-1], bounds[1:]):
            if end - start >= self.size:
                out.append(np.unique(hashes[start:end - self.size + 1]))
            elif end > start:
                short = mixed((prefix[end:end + 1] - prefix[start:start + 1]) * self.rolling.down[start:start + 1] + np.uint64(end - start))
                out.append(mixed(short))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def class_of(tokens: np.ndarray) -> int:
    """A hash of the set."""
    total = np.add.reduce(mixed(tokens ^ np.uint64(0x5DEECE66D1234567)), initial=np.uint64(0)) + np.uint64(len(tokens))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


@lru_cache(maxsize=4)
def size_bands(percent: int) -> list[int]:
    """Least sizes of the bands; a linked set is in the same band or in a neighbouring one."""
    # below the first size only equal sets can be linked
    bounds = [max(1, -(-percent // (100 - percent)))] if percent < 100 else [1 << 40]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 10_000 // (percent * percent) + 1)
    return bounds


def band_parts(low: int, high: int, percent: int) -> tuple[int, int]:
    """Number of parts for sets of at most ``high - 1`` tokens, and how many of them may be empty without a key."""
    differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
    spare = 2 + -(-differ // 20)
    return differ + 1 + spare, spare


def part_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the parts of a set, for its band and for the next one where a larger partner can be there."""
    n, bounds = len(tokens), size_bands(percent)
    if n < bounds[0]:
        return np.zeros(0, np.int64)
    band = bisect_right(bounds, n) - 1
    bands = [band] + ([band + 1] if n * 100 // percent >= bounds[band + 1] else [])
    spread, weight = mixed(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)), mixed(tokens)
    out = []
    for b in bands:
        parts, spare = band_parts(bounds[b], bounds[b + 1], percent)
        part = (spread % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        sums, names = np.add.reduceat(weight[order], starts), ranked[starts]
        if parts - len(starts) > spare:      # so many empty parts that they must count
            sums = np.concatenate([sums, np.zeros(parts - len(starts), np.uint64)])
            names = np.concatenate([names, np.setdiff1d(np.arange(parts), names)])
        place = np.uint64(b) * np.uint64(0x9E3779B97F4A7C15) + names.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(mixed(sums + mixed(place)) >> np.uint64(12))      # 52 bits: a chance match is only a vain search
    return np.concatenate(out).view(np.int64)


def linked(overlap: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


class Components:
    """Union-find over a block with roots at hand for whole arrays."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.root[a], self.root[b]))
        self.root[self.root == high] = low


def search_links(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> np.ndarray:
    """Root of each set in the forest of links inside a block; with ``sides``, only sets of different sides are compared."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    side = np.zeros(len(sets), np.int64) if sides is None else sides[order]
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_token = np.argsort(ids, kind="stable")            # inverted lists: owners of a token in ascending order
    lists, ends = owner[by_token], np.cumsum(np.bincount(ids, minlength=len(values)))
    begins = np.r_[0, ends[:-1]]
    places = ids[by_token] * len(sets) + lists            # the same lists as one ascending array, for the probes
    bounds = np.r_[0, np.cumsum(sizes)]
    found = Components(len(sets))
    for query in range(1, len(sets)):
        n = int(sizes[query])
        if n == 0:
            continue
        first = int(np.searchsorted(sizes, -(-percent * n // 100)))       # no smaller set reaches the overlap
        if first >= query:
            continue
        tokens = ids[bounds[query]:bounds[query + 1]]
        start, stop = begins[tokens], ends[tokens]
        lengths = stop - start
        need = -(-percent * n // 100)                     # occurrences that any answer has
        longest = max(1, int(lengths.max()))
        aside = min(need - 1, int(need / (MU * np.log2(longest + 1) + 1)))
        rank = np.argsort(lengths, kind="stable")
        short, long = rank[:n - aside], rank[n - aside:]
        # merge of the short lists
        short = short[lengths[short] > 1]                 # the others hold the query alone
        offsets = np.r_[0, np.cumsum(lengths[short])]
        merged = np.sort(lists[np.arange(offsets[-1]) + np.repeat(start[short] - offsets[:-1], lengths[short])], kind="stable")
        merged = merged[np.searchsorted(merged, first):np.searchsorted(merged, query)]
        if not len(merged):
            continue
        edge = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
        candidates, counts = merged[edge], np.diff(np.r_[edge, len(merged)])
        keep = (counts >= need - aside) & (found.root[candidates] != found.root[query])
        if sides is not None:
            keep &= side[candidates] != side[query]
        candidates, counts = candidates[keep], counts[keep]
        likely = np.argsort(-counts, kind="stable")
        candidates, counts = candidates[likely], counts[likely]
        take = 4
        while len(candidates):
            probe = candidates[:take]
            wanted = tokens[long][:, None] * len(sets) + probe       # binary search in each long list
            at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
            seen = counts[:take] + (places[at] == wanted).sum(axis=0)
            for c in probe[linked(seen, n, sizes[probe], percent)]:
                if found.root[c] != found.root[query]:
                    found.join(int(c), query)
            candidates, counts = candidates[take:], counts[take:]
            open_ = found.root[candidates] != found.root[query]
            candidates, counts = candidates[open_], counts[open_]
            take *= 4
    out = np.empty(len(sets), np.int64)
    out[order] = order[found.root]
    return out


def _classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, row, n, class, keys: size and hash of each text's set, and the keys of its parts, all from one look at the text."""
    none = np.zeros(0, np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sent = Shingler(shingle), set()
        for batch, texts in slices(batches):
            sets = shingler.sets([words_of(t) for t in texts])
            names, keys = [class_of(s) for s in sets], []
            for doc, name, tokens in zip(batch.column(0).to_pylist(), names, sets):
                fresh = doc is not None and name not in sent          # a copy in the same task has the same keys
                if fresh:
                    sent.add(name)
                keys.append(part_keys(tokens, percent) if fresh else none)
            bounds = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=bounds[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(keys)))],
                names=["doc_id", "row", "n", "class", "keys"])
    return docs.mapInArrow(scan, "doc_id long, row int, n long, class long, keys array<long>")


def _keys(classes: DataFrame) -> DataFrame:
    return classes.select(F.explode("keys").alias("key"), "class")


def _routes(keys: DataFrame) -> DataFrame:
    """(class, group) for every key that several classes have; the group is the key's least class."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, 0
        waiting = False                                  # the least class of a key is sent once a second one comes
        recent: set[tuple[int, int]] = set()
        for batch in batches:
            k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            same = np.r_[key is not None and k[0] == key, k[1:] == k[:-1]]
            after = np.r_[k[:-1] == k[1:], True]         # the last row's key may go on in the next batch
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(same | after):
                if not same[i]:
                    group, waiting = int(c[i]), True
                elif c[i] != group:
                    if waiting:
                        out.append((group, group))
                        waiting = False
                    out.append((int(c[i]), group))
            key = k[-1]
            fresh = [pair for pair in dict.fromkeys(out) if pair not in recent]
            if len(recent) > 200_000:
                recent.clear()
            recent.update(fresh)
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*fresh)], names=["class", "group"])
    return keys.repartition("key").sortWithinPartitions("key", "class").mapInArrow(stream, "class long, group long").distinct()


def _blocks(routes: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Routes with the two blocks (left, right) that meet and the class's own side; large groups have several blocks."""
    weighed = routes.join(sizes, "class")
    counts = weighed.groupBy("group").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int")
    placed = weighed.join(counts, "group").withColumn("own", own)
    return placed.select("doc_id", "row", "class", "group", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "doc_id", "row", "class", "group", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own")


def _links(docs: DataFrame, routes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that join each block's components."""
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch, texts in slices(batches):
            packed = [packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "row", "packed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, unpacker = Shingler(shingle), zstandard.ZstdDecompressor()
        block, members, sets, sides = None, [], [], []

        def answer() -> list[tuple[int, int]]:
            if len(members) < 2:
                return []
            roots = search_links(sets, percent, np.array(sides) if block[1] != block[2] else None)
            return [(members[i], members[r]) for i, r in enumerate(roots) if i != r]

        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            names = list(zip(*(c.to_pylist() for c in columns[:5])))
            for i, (group, left, right, own, name) in enumerate(names):
                if (group, left, right) != block:
                    out += answer()
                    block, members, sets, sides = (group, left, right), [], [], []
                if members and members[-1] == name:
                    continue                              # the same document read twice
                members.append(name)
                sides.append(own)
                sets += shingler.sets([unpacker.decompress(columns[5][i].as_py()).translate(LOWER).split()])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        if out := answer():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    packed = docs.mapInArrow(compress, "doc_id long, row int, packed binary")
    met = (packed.join(routes, ["doc_id", "row"]).select("group", "left", "right", "own", "class", "packed")
           .repartition("group", "left", "right").sortWithinPartitions("group", "left", "right", "class"))
    return met.mapInArrow(search, "a long, b long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the root is the least node of its component."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: greater neighbours to the least neighbour
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut_lineage(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                       block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), class."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.hash(F.col(text).cast("string")).alias("row"))
    known = written(_classes(rows, shingle, percent))
    first = (known.where("doc_id IS NOT NULL AND n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.max("n").alias("n"))
             .select("class", "first.*", "n"))
    full = rows.where("doc_id IS NOT NULL")
    routes = cut_lineage(_routes(_keys(known)))
    roots = connected_components(_links(full, _blocks(routes, first, block_shingles), shingle, percent))
    named = first.join(roots, first["class"] == roots["node"], "left").select("class", F.coalesce("root", "class").alias("root"), "doc_id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "root").select("class", "component_id")
    return known.join(of_class, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class",
        F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the first of their component; rows with a null id stay."""
    names = docs.columns
    found = jaccard_components(docs, doc_id, text).where("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs[doc_id] == found["__gone"], "left_anti").select(*names)


ORACLE = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS k FROM (
  SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - {SHINGLE} + 2, 2) AS BIGINT))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sets a JOIN sets b ON a.k = b.k WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * o >= {PERCENT} * (x.n + y.n - o)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS doc, doc_id AS c FROM docs UNION SELECT sides.b AS doc, reach.c FROM reach JOIN sides ON reach.doc = sides.a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT doc, min(c) AS c FROM reach GROUP BY doc) m ON d.doc_id = m.doc
"""
