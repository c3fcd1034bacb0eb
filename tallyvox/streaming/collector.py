"""The continuous job: landed listings and replies to the keyed post table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyvox.operators.enrich import enrich
from tallyvox.operators.language import LanguageModel
from tallyvox.operators.quality import is_bot
from tallyvox.sources.keyed_table import compact, write_log_batch
from tallyvox.sources.landed import read_listings, read_replies
from tallyvox.streaming.sinks import run_batches, stream_name


def landed_posts(spark: SparkSession, landing: str, **options: str) -> DataFrame:
    """Posts and comments as one stream, from `landing/listings` and `landing/replies`."""
    posts = read_listings(spark, f"{landing}/listings", stream=True, **options)
    comments = read_replies(spark, f"{landing}/replies", stream=True, **options)
    return posts.unionByName(comments)


def collect(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    language_model: LanguageModel,
    interval: str | None = "5 seconds",
    files_per_batch: int = 1000,
    compact_every: int | None = None,
    **enrich_options,
) -> StreamingQuery:
    """Start the job. With `interval` None it takes what has landed and ends.

    File offsets live in the checkpoint: after a failure or restart the job goes on with the
    files it has not committed, so no post is lost and none is counted twice. A cycle without
    new files is a success that writes nothing. The counts of each batch are in the query's
    progress under `observedMetrics`, at no extra job. With `compact_every`, each n-th batch
    folds the change log into the days it touches, which keeps later reads short.
    """
    bot = is_bot(F.col("author"), enrich_options.get("strict_bots", False))
    items = landed_posts(spark, landing, maxFilesPerTrigger=str(files_per_batch))
    # In a streaming plan the time is that of the batch, from the offset log: a repeat keeps it.
    items = items.withColumn("last_processed", F.current_timestamp()).observe(
        "batch",
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("parent_post_id").isNull()).alias("posts"),
        F.count_if(F.col("parent_post_id").isNotNull()).alias("comments"),
        F.count_if(~bot).alias("kept"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        enriched = enrich(batch, language_model, load_time=None, **enrich_options)
        write_log_batch(enriched, table, batch_id, stream_name(batch.sparkSession, checkpoint))
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, table)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return run_batches(items, write, checkpoint, trigger=trigger)
