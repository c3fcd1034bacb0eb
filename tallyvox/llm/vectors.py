"""Integer vectors in packed blocks, and blocks of queries that meet blocks of data in tasks of bounded size.

A vector's components become floor(256 * x). Rows are packed where they lie: each task keeps a
buffer of bounded size and cuts it into blocks by cell (whatever partition of space the caller
uses), so no shuffle sees single vectors and no hot vector or key makes a group larger. Blocks of
data are dealt to slices of bounded size, blocks of queries to groups of bounded size, and every
(group, slice) that has to meet is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.common import shuffle_partitions

SCALE = 256
BUFFER_VALUES = 1 << 22  # components a task holds while it packs
BLOCK_VALUES = 1 << 18
SLICE_VALUES = 1 << 20
GROUP_ROWS = 2048  # queries
CHUNK_SCORES = 1 << 21  # scores at a time
NO_KEY = (1 << 63) - 1  # stands for a null id
EXACT = 2.0**53  # sums of products below this are exact in doubles
KINDS = {2: "<i2", 4: "<i4", 8: "<f8"}
BLOCKS = "uid long, cell int, n int, width int, ids binary, labels binary, vectors binary, low array<double>, high array<double>"
NAMES = [field.split()[0] for field in BLOCKS.split(", ")]
SIDE = ["n", "width", "ids", "labels", "vectors"]


def points(rows: DataFrame, key: str, vector: str, label: Column | None = None) -> DataFrame:
    """(id, label, vector) of the rows whose vector is neither null nor holds a component that is
    null or not finite."""
    values = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.coalesce(~bad, F.lit(False))).select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("id"),
        (F.lit(0) if label is None else label).cast("long").alias("label"),
        F.col(f"`{vector}`").alias("vector"),
    )


def integers(column: pa.Array) -> np.ndarray:
    """floor(256 * x) of lists of numbers; shorter lists are filled up with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = np.zeros((len(sizes), int(sizes.max(initial=0))))
    found[np.arange(found.shape[1]) < sizes[:, None]] = np.floor(SCALE * flat)
    return found


def fit(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if width > matrix.shape[1] else matrix


def stack(matrices: list[np.ndarray]) -> np.ndarray:
    width = max((m.shape[1] for m in matrices), default=0)
    return np.concatenate([np.empty((0, width)), *(fit(m, width) for m in matrices)])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: doubles where they hold every sum, else Python integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a).dot(whole(b).T) if width else np.zeros((len(a), len(b)))


def as_long(scores: np.ndarray) -> np.ndarray:
    """Scores beyond 64 bits become the least or largest long."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores.tolist()], np.int64)


def _packed(matrix: np.ndarray) -> bytes:
    top = np.abs(matrix).max(initial=0)
    return matrix.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8").tobytes()


def packed(
    rows: DataFrame,
    describe: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]],
    arrange: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """`points` in blocks, each of one cell. `describe` gives the cells and some figures of
    vectors, of which a block keeps the least (low) and largest (high); `arrange` gives the order
    of the vectors in a block."""

    def blocks(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> Iterator[tuple]:
        cells, figures = describe(matrix)
        order, width = np.argsort(cells, kind="stable"), matrix.shape[1]
        size = max(1, BLOCK_VALUES // max(1, width))
        starts = np.flatnonzero(np.diff(cells[order], prepend=-1))
        for start, stop in zip(starts, [*starts[1:], len(order)]):
            for first in range(start, stop, size):
                at = order[first : min(first + size, stop)]
                if arrange:
                    at = at[arrange(matrix[at])]
                yield (
                    int(cells[at[0]]), len(at), width, ids[at].tobytes(), labels[at].tobytes(), _packed(matrix[at]),
                    figures[at].min(0).tolist(), figures[at].max(0).tolist(),
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, held, values = TaskContext.get().partitionId() << 33, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal uid
            ids, labels = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            for block in blocks(ids, labels, stack([h[2] for h in held])):
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, (uid, *block)))], BATCH)
                uid += 1

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                held.append((ids, labels, integers(part.column(2))))
                values += max(len(ids), held[-1][2].size)
                if values >= BUFFER_VALUES:
                    yield from flush()
                    held, values = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, BLOCKS)


BATCH = pa.schema(
    [("uid", pa.int64()), ("cell", pa.int32()), ("n", pa.int32()), ("width", pa.int32())]
    + [(name, pa.binary()) for name in ("ids", "labels", "vectors")]
    + [(name, pa.list_(pa.float64())) for name in ("low", "high")]
)


def unpacked(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of each block."""
    found = []
    for row in table.select(SIDE).to_pylist():
        n, width = row["n"], row["width"]
        kind = KINDS[len(row["vectors"]) // (n * width)] if width else "<f8"
        matrix = np.frombuffer(row["vectors"], kind).astype(np.float64).reshape(n, width)
        found.append((np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), matrix))
    return found


def dealt(parts: int) -> Column:
    """A slice for each block."""
    return F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")


def size() -> Column:
    return F.greatest("width", F.lit(1)) * F.col("n").cast("long")


def slices(blocks: DataFrame) -> int:
    """How many parts of about SLICE_VALUES components the blocks make."""
    total = blocks.agg(F.sum(size()).alias("values")).first()
    return max(1, -(-(total["values"] or 0) // SLICE_VALUES))


def share_out(amounts: np.ndarray, limit: int, order: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(first part, parts) of each cell, and the number of parts: cells, in their order, share a part
    while they amount to `limit` at most together; a larger cell has several parts."""
    first, parts, held, part = np.zeros(len(amounts), int), np.ones(len(amounts), int), 0, -1
    for cell in order:
        if part < 0 or held + amounts[cell] > limit:
            part, held = part + 1, 0
        first[cell], parts[cell] = part, max(1, -(-int(amounts[cell]) // limit))
        held += amounts[cell]
        part += parts[cell] - 1
    return first, parts, int(part) + 1


def spread(first: np.ndarray, parts: np.ndarray) -> Column:
    """A part for each block: one of its cell's."""
    starts, counts = (F.array(*[F.lit(int(n)) for n in numbers]) for numbers in (first, parts))
    return starts[F.col("cell")] + F.pmod(F.xxhash64("uid"), counts[F.col("cell")]).cast("int")


def meet(
    queries: DataFrame,
    data: DataFrame,
    solve: Callable[[pa.Table, pa.Table], Iterator[pa.Table]],
    schema: str,
    columns: list[str] = SIDE,
) -> DataFrame:
    """`solve` for the queries (`columns`) and the blocks of data of each (group, slice)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(solve(left, right)) if left.num_rows and right.num_rows else []
        return pa.concat_tables([empty, *found])

    empty = pa.table(
        {f.split()[0]: pa.array([], {"long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in schema.split(", ")}
    )
    keys = ["group", "slice"]
    # A given number: by the few bytes that make much work, all tasks would be coalesced into one.
    tasks = shuffle_partitions(data.sparkSession)
    place = [F.col(k).cast("int").alias(k) for k in keys]  # of one type, or the sides hash apart
    sides = queries.select(*place, *columns), data.select(*place, *SIDE)
    left, right = (side.repartition(tasks, *keys).groupBy(*keys) for side in sides)
    return left.cogroup(right).applyInArrow(run, schema)
