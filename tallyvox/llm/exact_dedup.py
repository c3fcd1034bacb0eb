"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised text, an external sort places equal texts next
to each other, and a window compares neighbours in full. Texts whose copies exceed a fair share
of one partition are salted first: each salt is a run of its own, and the few runs of such a text
are merged afterwards. The salt comes from the key and the input partition, so copies that share
the key, or have none, are split as well, and a repeated task salts its rows as before. There are at most `4 x partitions` such texts, since each holds more than
1 / (4 x partitions) of all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.llm.common import as_row, shuffle_partitions, stored

HEAD_CHARS = 16

Normalise = Callable[[Column], Column]


def unchanged(text: Column) -> Column:
    return text


def _hot_digests(texts: DataFrame, share: int) -> list[int]:
    """Digests of texts with more than 1 / `share` of all rows: fewer than `share` of them. A
    digest only steers the salt; equality is decided on the texts."""
    rows = texts.count()
    counted = texts.groupBy(F.xxhash64("text").alias("digest")).agg(F.count("*").alias("n"))
    hot = counted.where(F.col("n") * share > rows).where("n > 1")
    return [row.digest for row in hot.select("digest").collect()]


def group_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: str = "smallest",
    normalise: Normalise = unchanged,
    whole_rows: bool = False,
) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256 of the normalised text.

    Of equal texts the row with the `smallest` or `largest` key stays; of rows that also share
    the key exactly one stays, and a null key stays only if it is the only one. A null text counts
    as empty. `whole_rows` returns just the rows that stay, with all their columns in `row`.
    An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = docs.sparkSession
    share = 4 * shuffle_partitions(spark)
    body = normalise(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text")
    hot = _hot_digests(docs.select(body), share)
    id_ = F.col(f"`{key}`").alias("id")
    texts = docs.select(body, id_, *([as_row(docs)] if whole_rows else []))
    # Splitters are sampled from what sorts first: the head of the text, its digest, the salt. So
    # the sample that the driver sees stays small however long the texts are.
    digest = F.xxhash64("text")
    salt = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(share // 2)) + 1
    sorts = {
        "head": F.substring("text", 1, HEAD_CHARS),
        "digest": digest,
        "salt": F.when(digest.isin(hot), salt).otherwise(F.pmod(digest, F.lit(1))),
    }
    ordered = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    run = Window.partitionBy(*sorts, "text").orderBy(ordered)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        texts.withColumns(sorts)
        .repartitionByRange(*sorts)
        .withColumns(
            {
                "place": F.row_number().over(run),
                "best": F.first("id").over(whole),
                "copies": F.count("*").over(whole),
            }
        )
    )
    if whole_rows:
        runs = runs.where("place = 1")
    runs = stored(
        runs.select(
            "id",
            "salt",
            "place",
            "best",
            "copies",
            F.sha2("text", 256).alias("sha"),
            F.when((F.col("salt") > 0) & (F.col("place") == 1), F.col("text")).alias("hot_text"),
            *(["row"] if whole_rows else []),
        ),
        "copy-runs",
    )
    # The runs of a salted text, compared in full once more: a row for each of a bounded number.
    best = F.struct(F.col("best"), F.col("salt"))
    first = F.min if keep == "smallest" else F.max
    missing = F.struct(F.col("best").isNull() if keep == "smallest" else F.col("best").isNotNull(), best)
    merged = (
        runs.where("hot_text IS NOT NULL")
        .groupBy("hot_text")
        .agg(first(missing).alias("first"), F.sum("copies").alias("total"))
        .select(F.sha2("hot_text", 256).alias("sha"), F.col("first.col2.*"), "total")
        .withColumnsRenamed({"best": "hot_best", "salt": "hot_salt"})
    )
    joined = runs.join(F.broadcast(merged), "sha", "left")  # at most 4 x partitions rows
    stays = (F.col("place") == 1) & (
        F.col("hot_salt").isNull() | (F.col("hot_salt") == F.col("salt"))
    )
    if whole_rows:
        return joined.where(stays).select("row")
    return joined.select(
        F.col("id").alias(key),
        F.when(F.col("total").isNull(), F.col("best")).otherwise(F.col("hot_best")).alias("keep_id"),
        F.coalesce("total", "copies").alias("group_size"),
        stays.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of the input."""
    return group_copies(docs, whole_rows=True, **options).select("row.*")
