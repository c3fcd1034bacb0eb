"""Fair admission: in each cycle a source gives at most its quota; the rest waits and comes first
in the next cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyvox.operators.ranking import top_k, top_k_per_group
from tallyvox.schema import POST_KEY
from tallyvox.streaming.sinks import run_batches

SINCE = "waiting_since"  # the cycle in which a row arrived


def admit(waiting: DataFrame, quota: int, sources: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(admitted, rest) of rows that wait. Per source the longest waiting come first, then the
    oldest. With `sources`, only so many take part: those whose rows have waited longest, so that
    they take turns. Keys are unique.

    The first rows of a source are found by a limit that also runs before the shuffle, and the rest
    by leaving those out, so a source with most of the rows is never in one task."""
    order = [F.col(SINCE), F.col("created_utc"), F.col(POST_KEY)]
    eligible = waiting
    if sources is not None:
        oldest = waiting.groupBy("subreddit").agg(F.min(SINCE).alias("_since"))
        turn = top_k(oldest, [F.col("_since"), F.col("subreddit")], sources).select("subreddit")
        eligible = waiting.join(F.broadcast(turn), "subreddit", "left_semi")
    admitted = top_k_per_group(eligible, ["subreddit"], order, quota)
    return admitted, waiting.join(admitted.select(POST_KEY), POST_KEY, "left_anti")


def fair_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    quota: int,
    sources: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write what each cycle admits to `path/admitted` and what waits after it to `path/backlog`, a folder for
    each cycle. A cycle reads only the backlog of the one before, so one that is repeated after a
    failure decides the same and replaces what its first attempt left."""
    schema = T.StructType([*stream.schema.fields, T.StructField(SINCE, T.LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting = batch.withColumn(SINCE, F.lit(batch_id).cast("long"))
        if batch_id:
            before = spark.read.schema(schema).parquet(f"{path}/backlog/cycle={batch_id - 1}")
            waiting = before.unionByName(waiting)
        admitted, _ = admit(waiting, quota, sources)
        here = f"{path}/admitted/cycle={batch_id}"
        admitted.write.mode("overwrite").parquet(here)
        done = spark.read.schema(schema).parquet(here).select(POST_KEY)
        rest = waiting.join(done, POST_KEY, "left_anti")
        rest.write.mode("overwrite").parquet(f"{path}/backlog/cycle={batch_id}")

    return run_batches(stream, write, checkpoint, trigger=trigger)


def read_admitted(spark: SparkSession, path: str) -> DataFrame:
    """All admitted rows, with their cycle."""
    return spark.read.parquet(f"{path}/admitted").withColumn("cycle", F.col("cycle").cast("long"))


def read_backlog(spark: SparkSession, path: str) -> DataFrame:
    """The rows that wait after the last cycle."""
    every = spark.read.parquet(f"{path}/backlog").withColumn("cycle", F.col("cycle").cast("long"))
    # The folders tell the last cycle: one small row to the driver.
    last = read_admitted(spark, path).agg(F.max("cycle")).first()[0]
    return every.where(F.col("cycle") == last).drop("cycle")
