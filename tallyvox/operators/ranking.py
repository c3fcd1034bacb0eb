"""Top-k, per-group limits and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.session import checkpoint_root

# Spark puts a map-side limit below a rank filter up to this k.
MAP_SIDE_K = 1000
SPREAD = 32


def top_k(frame: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows; each task keeps k, no full sort."""
    return frame.orderBy(*order).limit(k)


def _hashable(frame: DataFrame) -> list[Column]:
    """Columns to spread rows by: all that can be hashed (maps cannot)."""
    return [F.col(f"`{n}`") for n, kind in frame.dtypes if "map<" not in kind] or [F.lit(0)]


def top_k_per_group(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int
) -> DataFrame:
    """The first k rows of each group. Spark applies the same limit before the shuffle, so a
    group that holds a large share of the rows sends at most k rows per map task. For larger k,
    where it does not, each group is first limited in `SPREAD` parts."""
    if k > MAP_SIDE_K:
        part = F.pmod(F.xxhash64(*_hashable(frame)), F.lit(SPREAD))
        within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
        frame = frame.withColumn("_part", part).withColumn("_rank", within)
        frame = frame.where(F.col("_rank") <= k).drop("_part", "_rank")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def ranked(frame: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number all rows 1..n in a total order without a single-task window.

    A range sort spreads the rows; each partition is numbered by itself and shifted by the
    sizes of the partitions before it. The sorted rows are checkpointed once, so that the
    sizes and the rows come from the same sort even after executors are lost.
    """
    checkpoint_root(frame.sparkSession)
    numbered = (
        frame.orderBy(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33).cast("int"))
        .checkpoint()
    )
    # One row per sort partition: the number of partitions bounds this window.
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_size").over(
                Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    position = F.col("_mid").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return (
        numbered.join(F.broadcast(before), "_part")
        .withColumn(name, position.cast("int"))
        .drop("_mid", "_part", "_before")
    )
