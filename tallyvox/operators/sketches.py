"""Daily sketches whose distinct counts add up: the headline of any range of days from stored rows.

Counts of different names are HyperLogLog sketches: merged, they count a name of several days once. With
2^12 buckets the relative standard error is about 1.6 per cent; a few dozen names are counted exactly.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.text import strip
from tallyvox.operators.entities import normalize_country, normalize_leader

LOG_BUCKETS = 12


def daily_sketches(loaded: DataFrame, log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """One row per day: posts, sums of scores and votes, voted posts, sketches of countries and leaders.

    Posts are first summed per day and pair of raw list columns; lists are split and named there."""
    cube = loaded.groupBy("date", "country", "leader").agg(
        F.count(F.lit(1)).alias("posts"),
        F.sum("sentiment_score").alias("score"),
        F.sum(F.col("upvotes").cast("bigint")).alias("votes"),
        F.count("upvotes").alias("voted"),
    )
    totals = ["posts", "score", "votes", "voted"]

    def names(column: str):
        parts = F.split(F.coalesce(F.col(column), F.lit("")), ",")
        return F.filter(F.transform(parts, strip), lambda x: x != "")

    lists = cube.select("date", *totals, names("country").alias("c"), names("leader").alias("l"))
    # One row for each place of the longer list; totals stand in the first.
    rows = lists.select("date", *totals, F.posexplode_outer(F.arrays_zip("c", "l")).alias("place", "name"))
    first = F.coalesce("place", F.lit(0)) == 0
    return rows.groupBy("date").agg(
        *[F.sum(F.when(first, F.col(c))).alias(c) for c in totals],
        F.hll_sketch_agg(normalize_country(F.col("name.c")), log_buckets).alias("countries"),
        F.hll_sketch_agg(normalize_leader(F.col("name.l")), log_buckets).alias("leaders"),
    )


def headline_between(sketches: DataFrame, first: date, last: date) -> DataFrame:
    """The headline of all days from `first` to `last`: one row, from one row per day."""
    days = sketches.where(F.col("date").between(F.lit(first), F.lit(last)))
    return days.agg(
        F.coalesce(F.sum("posts"), F.lit(0)).alias("total_posts"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("countries")), F.lit(0)).alias("countries"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("leaders")), F.lit(0)).alias("leaders"),
        F.try_divide(F.sum("score"), F.sum("posts")).alias("avg_sentiment"),
        F.try_divide(F.sum("votes"), F.sum("voted")).alias("avg_upvotes"),
    )
