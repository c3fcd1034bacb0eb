"""Stream sinks. A batch is stored under its id, so a batch that is run again after a failure
replaces what its first attempt left behind."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyvox.sources.keyed_table import write_log_batch

ONCE = {"availableNow": True}


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the query of this checkpoint: a new checkpoint is a new stream, wherever
    it lies. Known once the query has started."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def run_batches(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the query. Its state has as many partitions as the session's
    `spark.sql.shuffle.partitions` says at the first start; the checkpoint keeps that number."""
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def append_sink(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Parquet files with the file sink's own commit log: each row once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or ONCE))
        .start()
    )


def upsert_sink(
    stream: DataFrame, table: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Add each batch to the table's change log; cost follows the batch, not the table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_log_batch(batch, table, batch_id, stream_name(batch.sparkSession, checkpoint))

    return run_batches(stream, write, checkpoint, trigger=trigger)


def changes_sink(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Store the changed groups of an aggregation, batch by batch (update mode)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run_batches(stream, write, checkpoint, mode="update", trigger=trigger)


def latest_changes(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last stored row of each group."""
    changes = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("bigint"))
    values = [c for c in changes.columns if c not in keys and c != "batch_id"]
    return (
        changes.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch_id").alias("_last"))
        .select(*keys, "_last.*")
    )


def late_split_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    lateness: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Split each batch at the high-water mark: rows not newer than the mark go to the folder
    late=true, the others to late=false. The mark is the newest time of all earlier batches
    minus the allowed lateness. Each batch stores the newest time up to itself, so a repeated
    batch sees the same mark and only one small file is read for it."""
    marks, rows = f"{path}/marks", f"{path}/rows"

    def newest_before(spark: SparkSession, batch_id: int):
        if batch_id == 0:
            return None
        stored = spark.read.schema("newest timestamp").parquet(f"{marks}/batch_id={batch_id - 1}")
        return stored.first().newest

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = F.lit(newest_before(spark, batch_id)).cast("timestamp")
        late = F.col("created_utc") <= newest - F.expr(f"INTERVAL {lateness}")
        here = f"{rows}/batch_id={batch_id}"
        split = batch.withColumn("late", F.coalesce(late, F.lit(False)))
        split.write.mode("overwrite").partitionBy("late").parquet(here)
        # Read back one column of this batch; greatest skips a null on either side.
        stored = spark.read.schema("created_utc timestamp").parquet(here)
        stored.agg(F.greatest(F.max("created_utc"), newest).alias("newest")).write.mode(
            "overwrite"
        ).parquet(f"{marks}/batch_id={batch_id}")

    return run_batches(stream, write, checkpoint, trigger=trigger)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """All rows with the id of their batch and whether they came late."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumns(
        {"batch_id": F.col("batch_id").cast("bigint"), "late": F.col("late").cast("boolean")}
    )
