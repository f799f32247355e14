"""Hard negatives (operator 13): score windows searched in STR-packed R-trees.

The vectors are tiled: slabs by label and first component across partitions, then by
sort-tile-recursion inside a block, down to leaves. A leaf's bounding box gives, for each
coordinate, the interval of its product with the anchor's; their sums bound the inner
products inside. A queue takes the box that could hold the best score of the window first.
Boxes outside the window, of the wrong label, or strictly below the k-th score found are
not opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_blocks import (
    LEAST, MOST, BlockIndex, Packed, exact_kind, first_rows, one_per_id, packed, rows_in_block, seed_rows,
    whole_vectors, written,
)

LEAF = 128  # rows in a leaf
FANOUT = 16  # boxes in a box


def tiles(matrix: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Iterator[np.ndarray]:
    """The rows of each leaf: label by label, then sorted and cut along one dimension after the other."""
    dims = np.argsort(-matrix.var(axis=0), kind="stable") if matrix.size else np.empty(0, np.int64)

    def tile(rows: np.ndarray, used: int) -> Iterator[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if pages <= 1:
            yield rows
            return
        left = len(dims) - used
        slabs = max(2, int(np.ceil(pages ** (1 / left)))) if left > 1 else pages
        if left:
            rows = rows[np.argsort(matrix[rows, dims[used]], kind="stable")]
        size = -(-pages // slabs) * leaf
        for at in range(0, len(rows), size):
            yield from tile(rows[at:at + size], used + 1) if left > 1 else [rows[at:at + size]]

    rows = np.argsort(labels, kind="stable")
    ends = np.flatnonzero(np.diff(labels[rows])) + 1
    at = 0
    for end in [*ends.tolist(), len(rows)]:
        if end - at >= leaf or end == len(rows):  # rare labels share a tile
            if end > at:
                yield from tile(rows[at:end], 0)
            at = end


def arranged(rows: Packed) -> Packed:
    """The rows leaf by leaf, with ``leaf_ends``."""
    leaves = list(tiles(rows.matrix, rows.columns["label"]))
    order = np.concatenate(leaves)
    ends = np.cumsum([len(x) for x in leaves])
    return Packed(rows.matrix[order], {c: x[order] for c, x in rows.columns.items()} | {"leaf_ends": ends})


@dataclass
class Level:
    low: np.ndarray
    high: np.ndarray
    first_label: np.ndarray
    last_label: np.ndarray


class BoxTree:
    """The bounding boxes of a block's leaves, and of each ``FANOUT`` boxes up to the root's children."""

    def __init__(self, block: Packed, kind: type):
        self.rows = block.matrix.astype(kind)
        self.ids, self.labels = block.columns["id"], block.columns["label"]
        self.ends = block.columns["leaf_ends"]
        self.starts = np.append(0, self.ends[:-1])
        labels = (np.minimum, np.maximum)
        self.levels = [Level(
            np.minimum.reduceat(self.rows, self.starts), np.maximum.reduceat(self.rows, self.starts),
            *(f.reduceat(self.labels, self.starts) for f in labels),
        )]
        while len(self.levels[-1].low) > FANOUT:
            below, at = self.levels[-1], np.arange(0, len(self.levels[-1].low), FANOUT)
            self.levels.append(Level(
                np.minimum.reduceat(below.low, at), np.maximum.reduceat(below.high, at),
                np.minimum.reduceat(below.first_label, at), np.maximum.reduceat(below.last_label, at),
            ))


class AnchorSearch:
    """One anchor in one tree; windows share the intervals and scores that were computed."""

    def __init__(self, tree: BoxTree, vector: np.ndarray, own: int, label: int, same: bool):
        self.tree, self.vector, self.own, self.label, self.same = tree, vector, own, label, same
        self.up, self.down = np.maximum(vector, 0), np.minimum(vector, 0)
        self.boxes: dict[tuple[int, int], tuple] = {}
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def children(self, level: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest scores of some boxes, and whether they can hold a wanted label."""
        key = (level, first)
        if key not in self.boxes:
            x, s = self.tree.levels[level], slice(first, last)
            if self.same:
                fits = (x.first_label[s] <= self.label) & (self.label <= x.last_label[s])
            else:
                fits = (x.first_label[s] != self.label) | (x.last_label[s] != self.label)
            self.boxes[key] = (
                x.low[s] @ self.up + x.high[s] @ self.down, x.high[s] @ self.up + x.low[s] @ self.down, fits,
            )
        return self.boxes[key]

    def leaf(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the wanted rows of a leaf."""
        if number not in self.leaves:
            s = slice(self.tree.starts[number], self.tree.ends[number])
            wanted = ((self.tree.labels[s] == self.label) == self.same) & (self.tree.ids[s] != self.own)
            score = (self.tree.rows[s] @ self.vector).astype(np.int64)
            self.leaves[number] = self.tree.ids[s][wanted], score[wanted]
        return self.leaves[number]

    def window(self, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best wanted rows with scores from ``low`` to ``high``; ties by smaller id."""
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if low > high:
            return ids, scores
        tree, top = self.tree, len(self.tree.levels) - 1
        queue: list[tuple[float, int, int]] = []

        def opened(level: int, first: int) -> list[tuple[float, int, int]]:
            last = min(first + FANOUT, len(tree.levels[level].low))
            least, most, fits = self.children(level, first, last)
            best = np.minimum(most, high)
            inside = fits & (most >= low) & (least <= high)
            if len(scores) == k:
                inside &= best >= scores[-1]
            return [(-best[j], level, first + int(j)) for j in np.flatnonzero(inside)]

        queue = opened(top, 0)
        heapify(queue)
        while queue:
            best, level, box = heappop(queue)
            if len(scores) == k and -best < scores[-1]:
                break
            if level:
                for child in opened(level - 1, box * FANOUT):
                    heappush(queue, child)
                continue
            found, score = self.leaf(box)
            kept = (score >= low) & (score <= high)
            if len(scores) == k:
                kept &= score >= scores[-1]
            if kept.any():
                ids, scores = np.append(ids, found[kept]), np.append(scores, score[kept])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
        return ids, scores


def best_in_windows(block: Packed, chunk: Packed, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each request of a chunk, its ``k`` best rows of the block of the same or of another label."""
    dims = min(block.matrix.shape[1], chunk.matrix.shape[1])
    kind = exact_kind(block.matrix, chunk.matrix, dims)
    tree = BoxTree(Packed(block.matrix[:, :dims], block.columns), kind)
    vectors, columns = chunk.matrix[:, :dims].astype(kind), chunk.columns
    out, search, last = ([], [], []), None, None
    for place, own in enumerate(columns["id"].tolist()):
        if own != last:
            search, last = AnchorSearch(tree, vectors[place], own, columns["label"][place], same), own
        ids, scores = search.window(int(columns["low"][place]), int(columns["high"][place]), k)
        out[0].append(np.full(len(ids), place))
        out[1].append(ids)
        out[2].append(scores)
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in out)


def mine_hard_negatives(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its positives, rows of other labels that score close behind.

    Anchors are the rows that ``anchors`` holds for. Components become ``floor(scale * x)``, and a
    row's score is its inner product with the anchor. Positives are the anchor's first
    ``positives`` rows of its own label. For each of them the first ``negatives`` rows of
    other labels come back with ``low`` to ``high`` percent of the positive's score: none if
    that is negative. Ties go to the smaller id. Returns ``anchor_id``, ``positive_id``, ``rank``
    (from 1), ``negative_id``, ``positive_score`` and ``negative_score``.

    All rows are tiled into R-tree blocks of bounded size, whatever a label's share; anchors
    meet them block by block. Labels are integers.

    Rows with a null id, label or vector, or with null or non-finite components, take no part.
    Vectors of different lengths are compared as if filled up with zeros. Of rows that share
    an id, one is an anchor (with the least label and vector) and none is found for it; for
    others each counts, and a positive found twice gives its rows twice. An empty table gives
    an empty result. Other columns are not read.
    """
    labelled = df.where(F.col(label_col).isNotNull())
    label = F.col(label_col).cast("long")
    rows = whole_vectors(labelled, id_col, vector_col, label=label)
    total = df.count()
    dims = rows.select(F.max(F.size("vec"))).first()[0] or 0
    size = rows_in_block(df.sparkSession, total, dims)
    slabs = max(1, -(-total // size))
    tiled = rows.repartitionByRange(
        slabs, F.col("label"), F.get("vec", F.lit(0)), F.xxhash64("id")
    ).sortWithinPartitions("label", F.get("vec", F.lit(0)), F.xxhash64("id"))

    def table(source: DataFrame, name: str) -> DataFrame:
        return written(packed(source, size, scale, arrange=arranged, extra=["leaf_ends"]), name)

    seeds, blocks = table(seed_rows(rows, total), "seeds"), table(tiled, "blocks")

    def best(requests: DataFrame, keys: list[str], same: bool, k: int) -> DataFrame:
        names = ["id", "label", "leaf_ends"]
        answer = lambda block, chunk: best_in_windows(block, chunk, same, k)
        index = [BlockIndex(x, names, False, scale, answer) for x in (seeds, blocks)]
        return first_rows(*index, requests, keys, k)

    asked = one_per_id(whole_vectors(labelled.where(anchors), id_col, vector_col, label=label))
    near = best(asked.withColumns({"low": F.lit(LEAST), "high": F.lit(MOST)}), ["id"], True, positives)
    near = near.select(
        "id", F.col("rank").cast("long").alias("request"), F.col("found").alias("positive"),
        F.col("score").alias("positive_score"),
    )
    share = lambda percent, round_: round_(F.col("positive_score") * percent / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = written(near.join(asked, "id").withColumns({"low": share(low, F.ceil), "high": share(high, F.floor)}), "windows")
    found = best(windows, ["id", "request"], False, negatives)
    return found.select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int"),
        F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


OP13_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_inner_product(a.v, c.v)::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""


def op13_hard_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
