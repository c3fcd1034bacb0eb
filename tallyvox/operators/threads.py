"""Posts and their comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.operators.ranking import top_k_per_group
from tallyvox.schema import PARTITION_COLUMN


def posts_only(items: DataFrame) -> DataFrame:
    return items.where(F.col("parent_post_id").isNull())


def comments_only(items: DataFrame) -> DataFrame:
    return items.where(F.col("parent_post_id").isNotNull())


def with_kind(items: DataFrame) -> DataFrame:
    kind = F.when(F.col("parent_post_id").isNull(), "post").otherwise("comment")
    return items.withColumn("kind", kind)


def newer_than(posts: DataFrame, mark) -> DataFrame:
    """Strictly after the high-water mark; comments are not passed through this filter.

    A table stored by day also gets the condition on its day folders, which skips older ones.
    """
    mark = F.lit(mark).cast("timestamp")
    newer = posts.where(F.col("created_utc") > mark)
    if PARTITION_COLUMN in posts.columns:
        newer = newer.where(F.col(PARTITION_COLUMN) >= F.to_date(mark))
    return newer


def comments_of(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments whose post is in `posts`. The comments are the streamed side of a semi-join, so
    a post with very many of them is split by the adaptive skew handling."""
    parents = posts.select(F.col("post_id").alias("_parent"))
    return comments.join(parents, F.col("parent_post_id") == F.col("_parent"), "left_semi")


def batch_of(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """New posts and their comments as one batch."""
    return posts.unionByName(comments_of(posts, comments))


def newest_comments(comments: DataFrame, k: int, order=None) -> DataFrame:
    order = order or [F.col("created_utc").desc(), F.col("post_id")]
    return top_k_per_group(comments, ["parent_post_id"], order, k)


def thread_rollup(items: DataFrame) -> DataFrame:
    """One row per post with the size of its thread. Comments are summed per parent first, so
    the join has one row per key on both sides."""
    sizes = (
        comments_only(items)
        .groupBy(F.col("parent_post_id").alias("post_id"))
        .agg(
            F.count(F.lit(1)).alias("comments"),
            F.sum(F.length("text")).alias("comment_chars"),
            F.max(F.length("text")).alias("longest_comment"),
        )
    )
    return (
        posts_only(items)
        .select("post_id", "author")
        .join(sizes, "post_id", "left")
        .select(
            "post_id",
            "author",
            F.coalesce("comments", F.lit(0)).cast("bigint").alias("comments"),
            F.coalesce("comment_chars", F.lit(0)).cast("bigint").alias("comment_chars"),
            F.coalesce("longest_comment", F.lit(0)).cast("int").alias("longest_comment"),
        )
    )
