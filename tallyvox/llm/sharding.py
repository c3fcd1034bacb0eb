"""Shards in random order by a two-pass external shuffle.

Pass one scatters the rows, by seeded hashes, over buckets that fit in memory. Pass two gives each
bucket a Fisher-Yates shuffle (Spark's `shuffle` of an array is one) and writes it. A shard is a
run of as many buckets as its own bytes ask for, so a shard that one key makes large has more of them. The shard of a row depends on its key and the number of shards alone: the shard
with the highest seeded hash of the key wins, so one more shard takes rows only into itself.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.llm.common import as_row, shuffle_partitions

ROW_OVERHEAD = 16
BUCKET_BYTES = 16 << 20
BROADCAST_BUCKETS = 1_000_000  # of 16 bytes
OWN_COLUMNS = ("shard", "bucket", "slot")


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest hash. Adding a shard adds a candidate and changes no hash."""
    drawn = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(i)) for i in range(shards)]
    return (F.greatest(*drawn) if shards > 1 else drawn[0])["col2"]


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 0,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Write all rows below `path` as Parquet, a folder `shard=<n>` each, and return what was
    written: the columns of `docs`, bucket, slot (the row's place in its shard, gapless from 0)
    and shard. Columns of `docs` named shard, bucket or slot are kept as `<name>_in`.

    The same input, seed and sizes give the same slots. Null keys and texts are hashed like any
    value; repeated rows each get a slot. Rows that share a key share a shard, and spread over its
    buckets by their texts; rows that share both share a bucket, so the keys are meant to be
    unique, or nearly so. An empty table writes no shard and returns no row.
    """
    spark = docs.sparkSession
    kept = docs.withColumnsRenamed({n: f"{n}_in" for n in OWN_COLUMNS})
    key, text = (f"{n}_in" if n in OWN_COLUMNS else n for n in (key, text))
    id_, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    shard = shard_of(id_, shards, seed)
    held = dict(kept.groupBy(shard.alias("shard")).agg(F.sum(row_size(body))).collect())  # a row per shard
    each = [max(1, -(-held.get(i, 0) // bucket_bytes)) for i in range(shards)]
    first = [0, *accumulate(each)]  # bucket of each shard, then the number of buckets
    partitions = min(first[-1], max(shards, shuffle_partitions(spark)))
    # The text is hashed too, so that rows of one key still spread over the buckets.
    drawn = F.xxhash64(id_, F.xxhash64(body), F.lit(seed))
    bucket = F.get(F.lit(first), "shard") + F.pmod("draw", F.get(F.lit(each), "shard")).cast("int")
    scattered = (
        kept.select(shard.alias("shard"), drawn.alias("draw"), as_row(kept))
        .select("shard", bucket.alias("bucket"), F.struct(F.xxhash64("draw").alias("draw"), "row").alias("entry"))
        .withColumn("part", F.pmod("bucket", F.lit(partitions)))
    )
    sizes = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    # A row per bucket. Beyond the bound the join goes by the bucket like any other.
    starts = F.broadcast(starts) if first[-1] <= BROADCAST_BUCKETS else starts
    by_draw = lambda a, b: F.when(a.draw < b.draw, -1).when(a.draw > b.draw, 1).otherwise(0)
    shuffled = (
        scattered.repartitionById(partitions, "part")
        .groupBy("part", "bucket")
        .agg(F.collect_list("entry").alias("entries"))
        # Sorted twice, so that the generator of each partition meets the same rows on a retry.
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle(F.array_sort("entries", by_draw), seed).alias("entries"))
        .join(starts, "bucket")
        .select("shard", "bucket", "start", F.posexplode("entries").alias("pos", "entry"))
        .select("entry.row.*", "shard", "bucket", (F.col("start") + F.col("pos")).alias("slot"))
    )
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(shuffled.schema).parquet(path)
