"""What a checkpoint holds after a restart, compared with what the stream has stored.

Spark reads a checkpoint's state as a table; nothing here parses its files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.schema import POST_KEY
from tallyvox.streaming.feeds import LATENESS


def state_rows(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """(key, value, partition_id) of a stateful operator after its last committed batch."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint)


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per stateful operator: its name, partitions and the batches its state spans."""
    return spark.read.format("state-metadata").load(checkpoint)


def differing(state: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """One row: `in_state` rows of the state, and `differing` rows that only one of the two has."""
    sides = state.select(*on, F.lit(1).alias("_n")), stored.select(*on, F.lit(-1).alias("_n"))
    balance = sides[0].unionByName(sides[1]).groupBy(*on).agg(
        F.sum("_n").alias("_n"), F.count_if(F.col("_n") > 0).alias("in_state")
    )
    return balance.agg(
        F.coalesce(F.sum("in_state"), F.lit(0)).alias("in_state"),
        F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("differing"),
    )


def cursor_differences(spark: SparkSession, checkpoint: str, latest: DataFrame) -> DataFrame:
    """The cursors in the state of `source_cursor` against the rows last stored for each source."""
    state = state_rows(spark, checkpoint).select("key.subreddit", "value.max.*")
    return differing(state, latest, ["subreddit", "post_id", "created_utc"])


def dedupe_differences(
    spark: SparkSession, checkpoint: str, stored: DataFrame, lateness: str = LATENESS
) -> DataFrame:
    """The keys in the state of `on_time` against the stored rows that the watermark keeps open: a
    key stays until the mark, `lateness` before the newest row, has passed its time by `lateness`."""

    def later(time: Column) -> Column:
        return time + F.expr(f"INTERVAL {lateness}")

    state = state_rows(spark, checkpoint).select(
        f"key.{POST_KEY}", F.timestamp_micros("value.expiresAtMicros").alias("expires")
    )
    mark = stored.agg(F.date_trunc("millisecond", F.max("created_utc")).alias("_newest"))
    open_ = stored.select(POST_KEY, later(F.col("created_utc")).alias("expires")).join(F.broadcast(mark))
    return differing(state, open_.where(later(F.col("expires")) > F.col("_newest")), [POST_KEY, "expires"])
