"""Hard negatives by best-first search in STR-packed R-trees.

Vectors become integers. Range partitions by (label, widest coordinate) are the slabs of the first sort-tile-recursive
level; inside a partition rows are tiled further by the next widest coordinates and packed into leaves, leaves into nodes.
Each tree is one row: vectors, labels and the least and greatest value of every coordinate per leaf and node. A box and
an anchor give an interval of inner products, coordinate by coordinate; labels are one more coordinate of the box.

Anchors travel in blocks and meet every tree of their cell in an ordinary join (a stated query set against all rows). Cells
are the range partitions, and a block is copied once per cell: a cell is one tree up to PARTS trees, then it holds several,
about PART_TREES at most. All joins are by sort and merge: a block copied to all cells counts in Spark's estimate as the
block alone, so that all copies would be broadcast through the driver.

Per anchor a queue opens the box with the greatest upper bound first and drops boxes that hold no wanted label, that lie
outside all score windows, or whose upper bound is strictly below the k-th score so far; thresholds are carried from tree
to tree of a task. Each tree returns its best rows per anchor and Spark merges them, first for the positives, then for the
windows that follow from their scores.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; a vector with
fewer components than another counts as zero there. Rows that repeat an id are rows of their own, and anchors and
candidates of their own; a row is never its own positive. An empty table gives an empty result. Other columns are not
read. Inner products must fit 64 bits, else the job stops with a ValueError.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SCALE = 256
LEAF = 64
FAN = 8
TREE_BYTES = 1 << 20
BLOCK = 256
TILES = 3
REMEMBERED_BLOCKS = 1000
PARTS = 64
PART_TREES = 32


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """Valid rows with their integer vectors: row, vec_id, label, vector."""
    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3)
            sizes = np.diff(vectors.offsets.to_numpy())
            values = np.floor(float(scale) * vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(values)], minlength=len(sizes))
            good = bad == 0
            kept = values[np.repeat(good, sizes)]
            if np.abs(kept).max(initial=0) >= 2.0 ** 62:
                raise ValueError("a component does not fit 64 bits")
            kept = kept.astype(np.int64)
            offsets = np.append(0, np.cumsum(sizes[good])).astype(np.int32)
            head = [batch.column(i).filter(pa.array(good)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))], names=["row", "vec_id", "label", "vector"])
    return rows.mapInArrow(quantise, "row long, vec_id long, label long, vector array<long>")


def coordinate_spread(vectors: DataFrame) -> list:
    """Per coordinate: rows that have it, variance, greatest absolute value. Summed per task, then by Spark."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, square, top = (np.zeros(0) for _ in range(4))
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy().astype(np.float64)
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            width = max(int(sizes.max(initial=0)), len(count))
            count, total, square, top = (np.pad(x, (0, width - len(x))) for x in (count, total, square, top))
            count += np.bincount(place, minlength=width)
            total += np.bincount(place, values, width)
            square += np.bincount(place, values * values, width)
            np.maximum.at(top, place, np.abs(values))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), *map(pa.array, (count, total, square, top))], names=["at", "n", "s", "q", "top"])
    found = vectors.select("vector").mapInArrow(moments, "at long, n double, s double, q double, top double")
    spread = F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)
    return found.groupBy("at").agg(F.sum("n").alias("n"), spread.alias("spread"), F.max("top").alias("top")).orderBy("at").collect()


def narrow(values: np.ndarray) -> np.ndarray:
    """The smallest integer type that holds the values."""
    top = int(np.abs(values).max(initial=0))
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def matrix_of(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def tiles(keys: np.ndarray, order: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Sort-tile-recursive: slabs along the first key, each tiled by the keys after it, down to leaves of row numbers."""
    if len(order) <= leaf or not len(keys):
        return [order[i:i + leaf] for i in range(0, len(order), leaf)]
    order = order[np.argsort(keys[0][order], kind="stable")]
    leaves = -(-len(order) // leaf)
    slabs = max(1, round(leaves ** (1 / len(keys)) + 0.5)) if len(keys) > 1 else leaves
    size = -(-leaves // slabs) * leaf
    return [t for i in range(0, len(order), size) for t in tiles(keys[1:], order[i:i + size], leaf)]


def build_tree(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, dims: list[int], leaf: int = LEAF, fan: int = FAN) -> dict:
    """Rows in leaf order and, per level from the leaves up, first child and box of each node (the label is the last coordinate)."""
    parts = tiles(np.array([labels, *(vectors[:, d] for d in dims)]), np.arange(len(rows)), leaf)
    order = np.concatenate(parts)
    starts = np.append(0, np.cumsum([len(p) for p in parts]))
    full = np.column_stack([vectors, labels])[order]
    low, high, levels = full, full, []
    while True:
        low, high = np.minimum.reduceat(low, starts[:-1]), np.maximum.reduceat(high, starts[:-1])
        levels.append((starts, narrow(low), narrow(high)))
        if len(low) == 1:
            break
        starts = np.append(np.arange(0, len(low), fan), len(low))
    return {"rows": rows[order], "ids": ids[order], "labels": labels[order], "vectors": narrow(vectors[order]), "levels": levels}


def parts_of(wanted: int) -> int:
    """Partitions for so many trees or blocks: each its own up to PARTS, then several to one, PART_TREES at most."""
    return max(1, min(wanted, PARTS), -(-wanted // PART_TREES))


def met(left: DataFrame, right: DataFrame, by: str | list[str]) -> DataFrame:
    """An inner join without a broadcast, whatever Spark takes the sizes of packed and copied rows to be."""
    return left.join(right.hint("merge"), by)


def plant(vectors: DataFrame, dims: list[int], width: int, tree_rows: int, leaf: int) -> DataFrame:
    """One row per tree: part (of the range partitioning) and the pickled tree."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def tree() -> pa.RecordBatch:
            rows, ids, labels, matrix = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                               pa.array([pickle.dumps(build_tree(rows, ids, labels, matrix, dims, leaf), 5)], pa.binary())], names=["part", "tree"])
        for batch in batches:
            for at in range(0, batch.num_rows, tree_rows):
                piece = batch.slice(at, tree_rows)
                held.append((*(piece.column(i).to_numpy() for i in range(3)), matrix_of(piece.column(3), width)))
                size += piece.num_rows
                if size >= 2 * tree_rows:
                    yield tree()
                    held, size = [], 0
        if held:
            yield tree()
    by = ["label", *(F.get("vector", d) for d in dims[:1]), "vec_id", "row"]
    dealt = vectors.repartitionByRange(parts_of(-(-vectors.count() // tree_rows)), *by).sortWithinPartitions(*by)
    return dealt.select("row", "vec_id", "label", "vector").mapInArrow(grow, "part long, tree binary")


def anchor_blocks(anchors: DataFrame, width: int, size: int) -> DataFrame:
    """Blocks of anchors: block and the pickled (rows, ids, labels, vectors)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                load = (*(part.column(i).to_numpy().copy() for i in range(3)), narrow(matrix_of(part.column(3), width)))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pickle.dumps(load, 5)], pa.binary())], names=["block", "anchors"])
                number += 1
    dealt = anchors.repartition(parts_of(-(-anchors.count() // size)))
    return dealt.select("row", "vec_id", "label", "vector").mapInArrow(pack, "block long, anchors binary")


class Tree:
    """An opened tree: bounds of every node for a block of anchors, then one queue per anchor."""

    def __init__(self, packed: dict, kind: type) -> None:
        self.rows, self.ids, self.labels = packed["rows"], packed["ids"], packed["labels"]
        self.vectors = packed["vectors"].astype(kind)
        self.levels = [(starts.tolist(), low.astype(kind), high.astype(kind)) for starts, low, high in packed["levels"]]

    def bounds(self, anchors: np.ndarray) -> None:
        """Per level and anchor: greatest and least inner product with each box; least and greatest label of each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        self.upper = [(up @ high[:, :-1].T + down @ low[:, :-1].T).tolist() for _, low, high in self.levels]
        self.lower = [(up @ low[:, :-1].T + down @ high[:, :-1].T).tolist() for _, low, high in self.levels]
        self.least = [low[:, -1].tolist() for _, low, _ in self.levels]
        self.most = [high[:, -1].tolist() for _, _, high in self.levels]

    def search(self, slot: int, anchor: np.ndarray, label: int, own: int, windows: list[list], same: bool, stats: list | None = None) -> list[list[tuple]]:
        """Best rows per window ``[low, high, threshold, wanted]`` as (-score, id), over rows of the same or of other labels.

        A row counts if its score is in the window and not below the threshold, which rises to the ``wanted``-th best score.
        """
        found: list[list[tuple]] = [[] for _ in windows]
        queue: list[tuple] = []
        floor = min(max(w[0], w[2]) for w in windows)
        roof = max(w[1] for w in windows)

        def push(level: int, node: int) -> None:
            top = self.upper[level][slot][node]
            least, most = self.least[level][node], self.most[level][node]
            if top < floor or not (least <= label <= most if same else least != label or most != label):
                return
            bottom = self.lower[level][slot][node]
            if any(bottom <= w[1] and top >= w[0] and top >= w[2] for w in windows):
                heapq.heappush(queue, (-top, level, node))

        push(len(self.levels) - 1, 0)
        while queue:
            top, level, node = heapq.heappop(queue)
            if -top < floor:
                break    # all that is left is strictly below every window's k-th score or lower end
            if stats is not None:
                stats[0] += 1
            first, end = self.levels[level][0][node], self.levels[level][0][node + 1]
            if level:
                for child in range(first, end):
                    push(level - 1, child)
                continue
            scores = self.vectors[first:end] @ anchor
            right = self.labels[first:end] == label if same else self.labels[first:end] != label
            hits = np.flatnonzero(right & (scores >= floor) & (scores <= roof))
            if not len(hits):
                continue
            values, ids = [int(s) for s in scores[hits]], self.ids[first + hits].tolist()
            mine = (self.rows[first + hits] == own).tolist()
            for window, best in zip(windows, found):
                fresh = [(-s, i) for s, i, m in zip(values, ids, mine) if not m and window[0] <= s <= window[1] and s >= window[2]]
                if fresh:
                    best += fresh
                    best.sort()
                    del best[window[3]:]
                    if len(best) == window[3]:
                        window[2] = max(window[2], -best[-1][0])
            floor = min(max(w[0], w[2]) for w in windows)
        return found


def _searcher(kind: type, positives: int, negatives: int | None, low: int, high: int):
    """Best rows of each (block, tree): block, slot, base, score, vec_id. ``base`` is the positive score of a window, else 0."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[tuple, int] = {}    # thresholds that this task has met in earlier trees
        blocks: set[int] = set()
        lowest = np.iinfo(np.int64).min
        opened, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, (rows, _, labels, vectors), packed = batch.column(0)[i].as_py(), pickle.loads(batch.column(1)[i].as_py()), batch.column(2)[i].as_py()
                if packed != opened:
                    opened, tree = packed, Tree(pickle.loads(packed), kind)
                blocks.add(block)
                if len(blocks) > REMEMBERED_BLOCKS:
                    reached.clear()
                    blocks = {block}
                anchors = vectors.astype(kind)
                tree.bounds(anchors)
                if negatives is None:
                    bases = {slot: [0] for slot in range(len(rows))}
                else:
                    bases = {}
                    for at in batch.column(3)[i].as_py():
                        if -(-low * at["score"] // 100) <= high * at["score"] // 100:
                            bases.setdefault(at["slot"], []).append(at["score"])
                out: list[tuple] = []
                for slot, own in bases.items():
                    if negatives is None:
                        windows = [[lowest, -lowest - 1, reached.get((block, slot, 0), lowest), positives]]
                    else:
                        windows = [[-(-low * s // 100), high * s // 100, reached.get((block, slot, s), lowest), negatives] for s in own]
                    found = tree.search(slot, anchors[slot], int(labels[slot]), int(rows[slot]), windows, negatives is None)
                    for base, window, best in zip(own, windows, found):
                        reached[block, slot, base] = window[2]
                        out += [(block, slot, base, -s, v) for s, v in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["block", "slot", "base", "score", "vec_id"])
    return search


FOUND = "block long, slot long, base long, score long, vec_id long"


def _ranked(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= limit)


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, leaf: int = LEAF, tree_bytes: int = TREE_BYTES, block: int = BLOCK) -> DataFrame:
    """Hard negatives per anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``. A negative's score lies between ``low`` and ``high`` percent of the positive's.
    """
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("vector"))
    rows = named.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector")
    rows = written(quantised(rows, scale))
    spread = coordinate_spread(rows)
    width = max(1, len(spread))
    reach = sum(int(s.top) ** 2 for s in spread)
    if reach >= 1 << 63:
        raise ValueError("inner products do not fit 64 bits")
    kind = np.float64 if reach < 1 << 53 else np.int64    # sums of whole numbers below 2**53 are exact in doubles
    dims = [s.at for s in sorted(spread, key=lambda s: (-s.spread, s.at))[:TILES]]
    trees = written(plant(rows, dims, width, max(leaf, tree_bytes // (2 * width)), leaf))
    blocks = written(anchor_blocks(rows.where(is_anchor), width, block))
    cells = (trees.agg(F.max("part")).first()[0] or 0) + 1

    def against_all(some: DataFrame, limit: int | None) -> DataFrame:
        dealt = some.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
        pairs = met(dealt, trees, "part")
        return pairs.select("block", "anchors", "tree", *([] if limit is None else ["bases"])).mapInArrow(_searcher(kind, positives, limit, low, high), FOUND)

    best = written(_ranked(against_all(blocks, None), ["block", "slot"], positives))
    # at most ``positives`` scores for each anchor of a block
    bases = best.groupBy("block").agg(F.collect_set(F.struct("slot", "score")).alias("bases"))
    worst = _ranked(against_all(met(blocks, bases, "block"), negatives), ["block", "slot", "base"], negatives)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = pickle.loads(batch.column(1)[i].as_py())[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch.column(0)[i].as_py())), pa.array(np.arange(len(ids))), pa.array(ids)], names=["block", "slot", "anchor_id"])
    anchors = blocks.mapInArrow(name, "block long, slot long, anchor_id long")
    pairs = met(best.select("block", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), anchors, ["block", "slot"])
    hard = worst.select("block", "slot", F.col("base").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return met(pairs, hard, ["block", "slot", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The table's labels as the query reads them: every seventh row's label is moved on by one.
MOVED_LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
ANCHOR = "vec_id % 50 = 0"
ORACLE = f"""
WITH rows AS (SELECT vec_id, {MOVED_LABEL} AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows AS a JOIN rows AS b ON a.vec_id <> b.vec_id WHERE a.{ANCHOR}),
positives AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score,
  row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM scores WHERE same) AS p WHERE place <= {POSITIVES}),
negatives AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM positives AS p JOIN scores AS s ON p.anchor_id = s.anchor_id AND NOT same
  WHERE {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {NEGATIVES}
"""
