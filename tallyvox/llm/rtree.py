"""Hard negatives found in an STR-packed R-tree.

Sort-tile-recursive packing: splitters of a bounded sample cut space into tiles, coordinate by
coordinate; each task packs its rows into blocks of one tile and, within a block, sorts and tiles
again down to pages. Boxes around pages and blocks are the tree. The inner product of a query with
a point of a box lies in a sum of intervals, one for each coordinate. A queue opens the box with
the highest possible score first and drops boxes that lie outside all score windows or strictly
below the k-th score found in each.

The positives of all anchors are searched first, in one open window; their scores make the windows
of the second search. Each task searches the blocks of one slice of the tree for one group of
anchors, and the local best are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.llm.common import stored
from tallyvox.llm.vectors import (
    GROUP_ROWS,
    NO_KEY,
    SLICE_VALUES,
    as_long,
    fit,
    integers,
    meet,
    packed,
    points,
    products,
    share_out,
    size,
    spread,
    stack,
    unpacked,
)

SAMPLE = 8192
TILE_ROWS = 1 << 16
MAX_TILES = 512  # beyond, tiles have more blocks
SPLIT_COORDINATES = 3
PAGE = 128
FOUND = "anchor_id long, place int, vec_id long, score long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# --- the tree --------------------------------------------------------------------------------


def widest(matrix: np.ndarray) -> list[int]:
    """The coordinates to cut by: those that spread most."""
    return np.argsort(-matrix.var(0), kind="stable")[:SPLIT_COORDINATES].tolist() if len(matrix) else []


class Tiles:
    """The tile of each vector: slabs of equal numbers of sampled vectors along one coordinate, each cut
    along the next."""

    def __init__(self, sample: np.ndarray, tiles: int):
        self.width, self.by = sample.shape[1], widest(sample)
        self.ways = max(1, round(tiles ** (1 / len(self.by)))) if self.by else 1
        self.cuts: dict[tuple, np.ndarray] = {}
        self._cut(sample, ())

    def _cut(self, some: np.ndarray, path: tuple) -> None:
        if len(path) == len(self.by):
            return
        values = some[:, self.by[len(path)]]
        at = np.sort(values)[[len(values) * i // self.ways for i in range(1, self.ways)]] if len(values) else np.empty(0)
        self.cuts[path] = at
        slab = np.searchsorted(at, values, side="right")
        for i in range(len(at) + 1):
            self._cut(some[slab == i], (*path, i))

    def __call__(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        matrix, tile = fit(matrix, self.width), np.zeros(len(matrix), np.int64)
        parts = {(): np.arange(len(matrix))}
        for depth, coordinate in enumerate(self.by):
            parts, before = {}, parts
            for path, rows in before.items():
                slab = np.searchsorted(self.cuts[path], matrix[rows, coordinate], side="right")
                tile[rows] = tile[rows] * self.ways + slab
                parts.update({(*path, i): rows[slab == i] for i in np.unique(slab).tolist()})
        return tile, np.zeros((len(matrix), 1))


def pages(matrix: np.ndarray) -> np.ndarray:
    """The order that packs vectors into pages of PAGE: sort, cut into slabs, sort each by the next."""
    by = widest(matrix)

    def tiled(rows: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        if len(rows) <= PAGE or depth == len(by):
            yield rows
            return
        rows = rows[np.argsort(matrix[rows, by[depth]], kind="stable")]
        total = -(-len(rows) // PAGE)
        slabs = int(np.ceil(total ** (1 / (len(by) - depth))))
        size = -(-total // slabs) * PAGE  # whole pages
        for start in range(0, len(rows), size):
            yield from tiled(rows[start : start + size], depth + 1)

    return np.concatenate([*tiled(np.arange(len(matrix)), 0)])


def tree(rows: DataFrame) -> DataFrame:
    """The blocks of `points`, stored: the leaves of the tree."""
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).select("vector").toArrow()
    sample = integers(drawn.column(0).combine_chunks())
    tiles = Tiles(sample, min(MAX_TILES, -(-total // TILE_ROWS)))
    return stored(packed(rows, tiles, pages), "tree")


# --- search ----------------------------------------------------------------------------------


class Box:
    """Boxes of a level, and the range of a query's scores in each."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        # The scores of a box: positive components of a query with one corner, negative with the other.
        self.corners = np.concatenate([np.concatenate([low, high], 1), np.concatenate([high, low], 1)])

    def ranges(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible scores. Rounding, where doubles are not exact, is allowed for."""
        width = self.corners.shape[1] // 2
        signed = fit(query[None, :], width)[0, :width]
        signed = np.concatenate([np.maximum(signed, 0), np.minimum(signed, 0)])
        found = self.corners @ signed
        slack = 1e-12 * (np.abs(self.corners) @ np.abs(signed))
        half = len(found) // 2
        return (found - slack)[:half], (found + slack)[half:]


class Leaves:
    """A block: its vectors in pages."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.ids, self.labels, self.matrix = ids, labels, matrix
        self.starts = np.arange(0, len(ids), PAGE)
        self.low, self.high = (f.reduceat(matrix, self.starts, axis=0) for f in (np.minimum, np.maximum))
        self.boxes = Box(self.low, self.high)

    def page(self, i: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = slice(self.starts[i], self.starts[i] + PAGE)
        return self.ids[part], self.labels[part], products(query[None, :], self.matrix[part])[0]


class ScoreWindow:
    """The k best of the scores from `low` to `high`."""

    def __init__(self, low, high, k: int):
        self.low, self.high, self.k, self.heap = low, high, k, []

    def least(self):
        """No score below this is wanted."""
        return max(self.low, self.heap[0][0]) if len(self.heap) == self.k else self.low

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for at in np.flatnonzero((scores >= self.least()) & (scores <= self.high)).tolist():
            entry = (scores[at], -int(ids[at]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def search(forest: list[Leaves], top: Box, query: np.ndarray, windows: list[ScoreWindow], wanted) -> None:
    """Fill the windows. `wanted` tells from ids and labels which rows count."""
    tick = count()
    queue: list[tuple] = []
    highs = np.array([w.high for w in windows])

    def push(boxes: Box, block: Leaves | None) -> None:
        lows = np.array([w.least() for w in windows])
        least, most = boxes.ranges(query)
        for i in np.flatnonzero(((most[:, None] >= lows) & (least[:, None] <= highs)).any(1)).tolist():
            heapq.heappush(queue, (-most[i], next(tick), least[i], block, i))

    push(top, None)
    while queue:
        most, _, least, block, i = heapq.heappop(queue)
        open_ = [w for w in windows if -most >= w.least() and least <= w.high]
        if not open_:
            if all(-most < w.least() for w in windows):
                return  # all that is left has lower scores
        elif block is None:
            push(forest[i].boxes, forest[i])
        else:
            ids, labels, scores = block.page(i, query)
            hit = wanted(ids, labels)
            for window in open_:
                window.add(ids[hit], scores[hit])


def searched(k: int, windows_of, same: bool):
    """Anchors' k best rows in each of their windows, of the same label or of another one."""

    def solve(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        forest = [Leaves(*block) for block in unpacked(right)]
        corners = (stack([f(t) for t in forest]) for f in (lambda t: t.low.min(0, keepdims=True), lambda t: t.high.max(0, keepdims=True)))
        top, found = Box(*corners), []
        ids, labels = (left.column(c).to_pylist() for c in ("id", "label"))
        queries = integers(left.column("vector").combine_chunks())
        for anchor, label, query, scores in zip(ids, labels, queries, left.column("scores").to_pylist()):
            windows = [ScoreWindow(low, high, k) for low, high in windows_of(scores)]
            if same:
                search(forest, top, query, windows, lambda i, c: (c == label) & (i != anchor))
            else:
                search(forest, top, query, windows, lambda i, c: c != label)
            found += [(anchor, place, -i, s) for place, w in enumerate(windows) for s, i in w.heap]
        if found:
            anchors, places, others, scores = zip(*found)
            columns = [anchors, pa.array(places, pa.int32()), others, as_long(np.array(scores, object))]
            yield pa.table(columns, names=[field.split()[0] for field in FOUND.split(", ")])

    return solve


def _merged(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    lowest: int = 30,
    highest: int = 90,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
) -> DataFrame:
    """For each key that `anchors`, a condition on the key, picks, and each of its `positives` best other
    rows of the same label: the `negatives` best rows of other labels whose score is between `lowest` and
    `highest` per cent of the positive's. Scores are inner products of the vectors' floor(256 * x),
    ties go to the smaller key: anchor_id, positive_id, rank (from 1), negative_id and both scores.

    Rows with a null label, or whose vector is null or holds a null or non-finite component, take no
    part; shorter vectors (also empty ones) are filled up with zeros. Rows with the anchor's key are
    not its positives. Repeated rows count each; an anchor's key that is repeated is searched once,
    with its smallest (label, vector). Null keys are found after all others and are no anchors.
    A positive without negatives gives no row, nor does one with a negative score. Scores beyond 64
    bits are returned as the nearest long. An empty table gives an empty result.
    """
    named = F.col(f"`{label}`") if isinstance(label, str) else label
    every = points(rows.where(named.isNotNull()), key, vector, named)
    blocks = tree(every)
    amounts = np.zeros(MAX_TILES + 1)
    for cell, values in blocks.groupBy("cell").agg(F.sum(size())).collect():  # a row for each tile
        amounts[cell] = values
    first, parts, total = share_out(amounts, SLICE_VALUES, np.flatnonzero(amounts).tolist())
    chosen = points(rows.where(anchors & named.isNotNull() & F.col(f"`{key}`").isNotNull()), key, vector, named)
    least = chosen.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least"))
    chosen = stored(least.select("id", "least.*"), "anchors")
    groups = -(-chosen.count() // GROUP_ROWS)
    if not groups:
        return rows.sparkSession.createDataFrame([], OUT)

    def found(asked: DataFrame, k: int, windows_of, same: bool) -> DataFrame:
        placed = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        placed = placed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
        dealt = blocks.withColumn("slice", spread(first, parts))
        dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        solve = searched(k, windows_of, same)
        return _merged(meet(placed, dealt, solve, FOUND, ["id", "label", "vector", "scores"]), k)

    def between(scores: list[int]) -> list[tuple[int, int]]:
        return [(-(-lowest * s // 100), highest * s // 100) for s in scores]

    one = F.array().cast("array<long>")
    near = found(chosen.withColumn("scores", one), positives, lambda _: [(-np.inf, np.inf)], True)
    near = stored(
        near.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive"), F.col("score").alias("positive_score")),
        "positives",
    )
    scores = F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"])
    windows = near.groupBy(F.col("anchor_id").alias("id")).agg(scores.alias("scores"))  # `positives` at most
    far = found(chosen.join(windows, "id"), negatives, between, False)
    return far.join(near, ["anchor_id", "place"]).select(
        "anchor_id",
        F.nullif("positive", F.lit(NO_KEY)).alias("positive_id"),
        "rank",
        F.nullif("vec_id", F.lit(NO_KEY)).alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
