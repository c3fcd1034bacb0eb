"""Comments of posts with the open items in stored tables: no state store, no state partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyvox.operators.threads import comments_only, posts_only
from tallyvox.schema import POST_KEY
from tallyvox.session import discard
from tallyvox.streaming.sinks import run_batches

MARKS = "posts timestamp, comments timestamp"


def comments_sink(
    items: DataFrame,
    path: str,
    checkpoint: str,
    within: str = "7 days",
    lateness: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Store comments whose post is known, each once, as `feeds.comments_feed` gives them, from one stream of
    posts and comments (`parent_post_id` is null, or not).

    Each batch joins what arrives and what is still open, and stores the comments that met their post
    (met=true) beside what stays open (met=false): posts within the bound and comments without a post, by
    the mark of all earlier batches. A batch reads only the folder of the one before, so one that is
    repeated after a failure decides the same and replaces what its first attempt left."""
    schema = T.StructType([*items.schema.fields, T.StructField("met", T.BooleanType())])
    is_post = F.col("parent_post_id").isNull()

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here, before = (f"{path}/rows/batch_id={i}" for i in (batch_id, batch_id - 1))
        newest = dict.fromkeys(("posts", "comments"), F.lit(None).cast("timestamp"))
        if batch_id:
            stored = spark.read.schema(MARKS).parquet(f"{path}/marks/batch_id={batch_id - 1}").first()
            newest = {side: F.lit(stored[side]).cast("timestamp") for side in newest}
        # The lesser of both sides' marks; there is none while one side is silent.
        earlier = F.when(newest["posts"] < newest["comments"], newest["posts"]).when(
            newest["posts"] >= newest["comments"], newest["comments"]
        )
        mark = earlier - F.expr(f"INTERVAL {lateness}")
        passed = lambda time: F.coalesce(time <= mark, F.lit(False))
        # What has no time meets nothing and would never be let go.
        arrived = batch.where(F.col("created_utc").isNotNull() & ~passed(F.col("created_utc")))
        if batch_id:
            last = F.col("created_utc") + F.when(is_post, F.expr(f"INTERVAL {within}")).otherwise(F.expr("INTERVAL 0 SECOND"))
            kept = spark.read.schema(schema).parquet(before).where("NOT met").drop("met")
            arrived = arrived.unionByName(kept.where(~passed(last)))
        posts, comments = posts_only(arrived), comments_only(arrived)
        parents = posts.select(F.col(POST_KEY).alias("_post"), F.col("created_utc").alias("_posted"))
        same = F.col("parent_post_id") == F.col("_post")
        meets = same & F.expr(f"created_utc >= _posted AND created_utc <= _posted + INTERVAL {within}")
        met = comments.join(parents, meets, "left_semi").withColumn("met", F.lit(True))
        left = comments.join(parents, meets, "left_anti").unionByName(posts).withColumn("met", F.lit(False))
        met.unionByName(left).write.mode("overwrite").partitionBy("met").parquet(here)
        # Read back two columns of this batch; greatest skips a null on either side.
        stored = spark.read.schema(schema).parquet(here)
        of = {"posts": F.when(is_post, F.col("created_utc")), "comments": F.when(~is_post, F.col("created_utc"))}
        marks = stored.agg(*(F.greatest(F.max(of[side]), newest[side]).alias(side) for side in newest))
        marks.write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")
        if batch_id > 1:  # the batch before is committed, so nothing reads what was open before it
            discard(spark, f"{path}/rows/batch_id={batch_id - 2}/met=false")

    return run_batches(items, write, checkpoint, trigger=trigger)


def read_comments(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """All comments that met their post, so far."""
    rows = spark.read.schema(T.StructType([*columns.fields, T.StructField("met", T.BooleanType())]))
    return rows.parquet(f"{path}/rows").where("met").select(*columns.names)
