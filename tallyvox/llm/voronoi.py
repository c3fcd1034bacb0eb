"""Exact top-k by inner product: a Voronoi kNN join.

Pivots split space into cells. Queries and data go to the cell of their nearest pivot, and small
summaries of the cells (rows, distances to the pivot, norms) bound every score between two cells:
2 q.x = |q|^2 + |x|^2 - |q - x|^2, and distances through pivots bound |q - x| from both sides. So each
query cell has a score that its k best surely reach, and a block of data goes to the groups of queries
that its best possible score does not rule out, and to no other. Groups are solved locally and the
local best merged.

The pivots are a bounded sample and decide how much is sent, not what is found. Where the bounds
tell nothing (vectors spread over many dimensions), every group gets all data, once for each 2,048
queries or so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.llm.common import stored
from tallyvox.llm.vectors import (
    CHUNK_SCORES,
    GROUP_ROWS,
    NO_KEY,
    as_long,
    dealt,
    fit,
    integers,
    meet,
    packed,
    points,
    products,
    share_out,
    slices,
    spread,
    stack,
    unpacked,
)

PIVOTS = 64
SLACK = 1e-9  # of the squares that a bound is made of: covers rounding
FOUND = "query_id long, vec_id long, score long"
OUT = "query_id long, rank int, vec_id long, score long"


class Cells:
    """The cell of each vector, its distance to the pivot and its norm."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots

    def __call__(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pivots, width = self.pivots, self.pivots.shape[1]
        square, inside = (matrix**2).sum(1), fit(matrix, width)[:, :width]
        apart = square[:, None] - 2 * inside @ pivots.T + (pivots**2).sum(1)
        cells = apart.argmin(1)
        nearest = np.maximum(apart[np.arange(len(matrix)), cells], 0)
        return cells, np.sqrt(np.stack([nearest, square], 1))


def find_pivots(rows: DataFrame) -> np.ndarray:
    """Up to PIVOTS different vectors, drawn by hash."""
    drawn = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(PIVOTS).select("vector").toArrow()
    return np.unique(integers(drawn.column(0).combine_chunks()), axis=0)


def summaries(blocks: DataFrame, cells: int) -> dict[str, np.ndarray]:
    """For each cell: rows, and the range of distances and of norms. A row for each pivot."""
    least, most = ([F.col(side)[i] for i in (0, 1)] for side in ("low", "high"))
    rows = blocks.groupBy("cell").agg(
        F.sum("n"), *[F.min(c) for c in least], *[F.max(c) for c in most]
    )
    table = np.zeros((cells, 5))
    for cell, *figures in rows.collect():
        table[cell] = figures
    return dict(zip(("rows", "near", "short", "far", "long"), table.T))


class Bounds:
    """Which query cells may need a block of data, from the summaries of both sides."""

    def __init__(self, pivots: np.ndarray, asked: dict, data: dict, k: int):
        square = (pivots**2).sum(1)
        self.apart = np.sqrt(np.maximum(square[:, None] + square - 2 * pivots @ pivots.T, 0))
        self.asked = asked
        # The score that the k best of every query in a cell reach: k rows are surely within
        # these distances.
        largest = asked["far"][:, None] + self.apart + data["far"]
        sure = (asked["short"][:, None] ** 2 + data["short"] ** 2 - largest**2) / 2
        sure -= SLACK * (largest**2 + 1)
        order = np.argsort(-sure, axis=1, kind="stable")
        reached = np.cumsum(data["rows"][order], axis=1) >= k
        first = reached.argmax(1)
        best = np.take_along_axis(sure, order, 1)[np.arange(len(sure)), first]
        self.least = np.where(reached.any(1), best, -np.inf)

    def __call__(self, cell: int, near: float, short: float, far: float, long: float) -> np.ndarray:
        apart, reach = self.apart[:, cell], self.asked["far"]
        gap = np.maximum(np.maximum(apart - reach - far, near - apart - reach), 0)
        squares = self.asked["long"] ** 2 + long**2
        best = np.minimum((squares - gap**2) / 2, self.asked["long"] * long)
        return (best + SLACK * (squares + apart**2 + 1) >= self.least) & (self.asked["rows"] > 0)


def chain(pivots: np.ndarray, rows: np.ndarray) -> list[int]:
    """The cells with rows, each followed by the nearest that is left."""
    found, left = [], set(np.flatnonzero(rows > 0).tolist())
    while left:
        at = min(left, key=lambda c: (((pivots[c] - pivots[found[-1]]) ** 2).sum() if found else 0, c))
        left.remove(at)
        found.append(at)
    return found


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k highest scores of each row, ties to the smaller column."""
    wide = scores.shape[1]
    if wide > k:
        kth = (np.sort(scores, 1) if scores.dtype == object else np.partition(scores, wide - k, 1))[:, wide - k, None]
        above, equal = scores > kth, scores == kth
        chosen = above | (equal & (np.cumsum(equal, 1) <= k - above.sum(1)[:, None]))
        columns = np.nonzero(chosen)[1].reshape(-1, k)
        scores = np.take_along_axis(scores, columns, 1)
    else:
        columns = np.broadcast_to(np.arange(wide), scores.shape)
    return np.take_along_axis(columns, np.argsort(-scores, axis=1, kind="stable"), 1)


def local_best(k: int):
    def solve(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        asked, data = unpacked(left), unpacked(right)
        query_ids, queries = np.concatenate([b[0] for b in asked]), stack([b[2] for b in asked])
        ids, vectors = np.concatenate([b[0] for b in data]), stack([b[2] for b in data])
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        step = max(1, CHUNK_SCORES // len(ids))
        for start in range(0, len(query_ids), step):
            some = query_ids[start : start + step]
            scores = products(queries[start : start + step], vectors)
            scores[some[:, None] == ids] = -np.inf
            columns = best(scores, k)
            found = np.take_along_axis(scores, columns, 1).ravel()
            kept = found > -np.inf
            yield pa.table(
                {
                    "query_id": np.repeat(some, columns.shape[1])[kept],
                    "vec_id": ids[columns.ravel()[kept]],
                    "score": as_long(found[kept]),
                }
            )

    return solve


def top_k(
    rows: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each key that `queries`, a condition on the key, picks: query_id, rank (from 1), vec_id and
    score of the k best other rows (all, if fewer) by inner product of the vectors' floor(256 * x),
    ties to the smaller key.

    Rows whose vector is null or holds a null or non-finite component take no part; shorter vectors
    (also empty ones) are filled up with zeros. Rows with the query's key are not its candidates.
    Rows repeated under another key's id are candidates each; a query key that is repeated is asked
    once, with its smallest vector. A null key is a candidate after all others. Scores beyond 64
    bits are returned as the nearest long. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    every = points(rows, key, vector)
    pivots = find_pivots(every)
    if not len(pivots):
        return spark.createDataFrame([], OUT)
    cells = Cells(pivots)
    asked = points(rows.where(queries & F.col(f"`{key}`").isNotNull()), key, vector)
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"), F.count("*").alias("copies"))
    asked = stored(asked, "queries")
    copies = asked.agg(F.max("copies")).first()[0]
    if copies is None:
        return spark.createDataFrame([], OUT)
    asked = stored(packed(asked.select("id", F.lit(0).cast("long").alias("label"), "vector"), cells), "query-blocks")
    data = stored(packed(every, cells), "data-blocks")
    asked_cells, parts = summaries(asked, len(pivots)), slices(data)
    bounds = Bounds(pivots, asked_cells, summaries(data, len(pivots)), k + copies)
    first, groups, _ = share_out(asked_cells["rows"], GROUP_ROWS, chain(pivots, asked_cells["rows"]))

    @F.arrow_udf("array<int>")
    def needed(cell: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        found = []
        for c, least, most in zip(cell.to_pylist(), low.to_pylist(), high.to_pylist()):
            hit = np.flatnonzero(bounds(c, *least, *most))
            found.append(sorted({g for i in hit for g in range(first[i], first[i] + groups[i])}))
        return pa.array(found, pa.list_(pa.int32()))

    every_slice = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.withColumn("group", spread(first, groups)).withColumn("slice", every_slice)
    right = data.withColumn("group", F.explode(needed("cell", "low", "high"))).withColumn("slice", dealt(parts))
    found = meet(left, right, local_best(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.nullif("vec_id", F.lit(NO_KEY)).alias("vec_id"), "score"
    )
