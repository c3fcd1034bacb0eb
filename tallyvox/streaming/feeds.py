"""Stream operators. Each takes and returns a streaming DataFrame of posts.

State is bounded by the one-hour watermark on `created_utc` (dedupe, trend) or by the number
of sources (cursor).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvox.schema import POST_KEY

LATENESS = "1 hour"


def posts_feed(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Files that arrive below `path`. `maxFilesPerTrigger` limits a batch; `cleanSource` and
    `sourceArchiveDir` move or delete files once the batch that read them is committed."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def on_time(posts: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The high-water mark: each key once, rows older than the mark dropped."""
    return posts.withWatermark("created_utc", lateness).dropDuplicatesWithinWatermark([POST_KEY])


def source_cursor(posts: DataFrame) -> DataFrame:
    """Newest post of each source so far. Emitted in update mode, one row per changed source."""
    newest = F.max(F.struct("created_utc", POST_KEY)).alias("_newest")
    return (
        posts.groupBy("subreddit")
        .agg(newest)
        .select("subreddit", "_newest.post_id", "_newest.created_utc")
    )


def daily_trend(posts: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Mean score and number of scored posts per day, kept open until the mark passes the day."""
    return (
        posts.where(F.col("sentiment_score").isNotNull())
        .withWatermark("created_utc", lateness)
        .groupBy(F.window("created_utc", "1 day").alias("_day"))
        .agg(
            F.avg("sentiment_score").alias("sentiment"),
            F.count("sentiment_score").alias("posts"),
        )
        .select(F.to_date("_day.start").alias("date"), "sentiment", "posts")
    )


def comments_feed(
    posts: DataFrame, comments: DataFrame, within: str = "7 days", lateness: str = LATENESS
) -> DataFrame:
    """Comments whose post is known, each once, as soon as both have arrived, in any order.

    A comment counts from its post's creation until `within` later. That bound and the watermarks
    (`lateness`: how far arrivals may be out of order) let both sides' state go: of posts that no
    comment can still meet, and of comments whose post can no longer come.
    """
    parents = posts.select(F.col(POST_KEY).alias("_post"), F.col("created_utc").alias("_posted"))
    parents = parents.withWatermark("_posted", lateness)
    same = F.col("parent_post_id") == F.col("_post")
    in_time = F.expr(f"created_utc >= _posted AND created_utc <= _posted + INTERVAL {within}")
    return comments.withWatermark("created_utc", lateness).join(parents, same & in_time, "left_semi")
