"""The post table at rest: create, append, scan and the report projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvox.functions.scores import clip_score
from tallyvox.functions.times import day_of_week, hour_of_day
from tallyvox.schema import PARTITION_COLUMN, POST_SCHEMA

REPORT_COLUMNS = [
    "post_id",
    "text",
    "sentiment_score",
    "country",
    "leader",
    "upvotes",
    "created_utc",
]


def create_if_absent(spark: SparkSession, path: str) -> None:
    """An empty table with the post schema, unless something is there already."""
    with_date = T.StructType([*POST_SCHEMA.fields, T.StructField(PARTITION_COLUMN, T.DateType())])
    empty = spark.createDataFrame([], with_date)
    # Unpartitioned on purpose: this file carries the schema, partitions come with the rows.
    empty.drop(PARTITION_COLUMN).write.mode("ignore").parquet(path)


def append_posts(posts: DataFrame, path: str) -> None:
    """Append, one folder per day. The rebalance hint merges small and splits large days."""
    dated = posts.withColumn(PARTITION_COLUMN, F.to_date("created_utc"))
    dated.hint("rebalance", PARTITION_COLUMN).write.mode("append").partitionBy(
        PARTITION_COLUMN
    ).parquet(path)


def scan_posts(
    spark: SparkSession, path: str, *columns: str, schema: T.StructType | str = POST_SCHEMA
) -> DataFrame:
    """Scan with a fixed schema; only the named columns are read."""
    frame = spark.read.schema(schema).parquet(path)
    return frame.select(*columns) if columns else frame


def load_posts(posts: DataFrame) -> DataFrame:
    """The projection behind all reports: scored posts with clipped scores and time features."""
    return (
        posts.select(*REPORT_COLUMNS)
        .where(F.col("sentiment_score").isNotNull())
        .withColumns(
            {
                "hour_of_day": hour_of_day(F.col("created_utc")),
                "day_of_week": day_of_week(F.col("created_utc")),
                "sentiment_score": clip_score(F.col("sentiment_score")),
                "date": F.to_date("created_utc"),
            }
        )
    )

