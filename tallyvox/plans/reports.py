"""Report queries over the post table.

Each report sums before it explodes: posts are first grouped by the raw list column, so that
splitting and naming run over distinct lists, not over posts, and only sums are shuffled.
"""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.scores import histogram_bin, show_count, show_score, show_time
from tallyvox.functions.text import strip
from tallyvox.functions.times import day_of_week, hour_of_day
from tallyvox.operators.entities import explode_list, normalize_country, normalize_leader
from tallyvox.operators.quality import is_bot
from tallyvox.operators.ranking import ranked, top_k

MIN_COUNTRY_POSTS = 10
MIN_LEADER_MENTIONS = 100
HISTOGRAM_BINS = 30

_NORMALIZERS = {"country": normalize_country, "leader": normalize_leader}


def explode_entities(posts: DataFrame, column: str) -> DataFrame:
    """One row per post and named entity, under the canonical name (column `entity`)."""
    items = explode_list(posts, column, "entity")
    return items.withColumn("entity", _NORMALIZERS[column](F.col("entity")))


def entity_stats(loaded: DataFrame, column: str) -> DataFrame:
    """(entity, sentiment, mentions, avg_upvotes) over the posts that name the entity."""
    sums = loaded.groupBy(column).agg(
        F.sum("sentiment_score").alias("_score"),
        F.count("sentiment_score").alias("_scored"),
        F.sum(F.col("upvotes").cast("bigint")).alias("_votes"),
        F.count("upvotes").alias("_voted"),
    )
    return (
        explode_entities(sums, column)
        .groupBy("entity")
        .agg(
            F.try_divide(F.sum("_score"), F.sum("_scored")).alias("sentiment"),
            F.sum("_scored").alias("mentions"),
            F.try_divide(F.sum("_votes"), F.sum("_voted")).alias("avg_upvotes"),
        )
    )


def country_stats(loaded: DataFrame) -> DataFrame:
    return entity_stats(loaded, "country").select(
        F.col("entity").alias("country"),
        F.col("sentiment").alias("avg_sentiment"),
        F.col("mentions").alias("post_count"),
        "avg_upvotes",
    )


def country_table(loaded: DataFrame, min_posts: int = MIN_COUNTRY_POSTS) -> DataFrame:
    """Countries with enough posts, most negative first."""
    return (
        country_stats(loaded)
        .where(F.col("post_count") >= min_posts)
        .select("country", F.col("avg_sentiment").alias("sentiment"), F.col("post_count").alias("posts"))
        .orderBy("sentiment", "country")
    )


def leader_stats(loaded: DataFrame) -> DataFrame:
    """Leaders, most mentioned first."""
    return _leaders(loaded).orderBy(F.col("mentions").desc(), F.col("leader"))


def _leaders(loaded: DataFrame, min_mentions: int = 0) -> DataFrame:
    stats = entity_stats(loaded, "leader").withColumnRenamed("entity", "leader")
    return stats.where(F.col("mentions") >= min_mentions) if min_mentions else stats


def rank_overall(loaded: DataFrame) -> DataFrame:
    return ranked(_leaders(loaded), [F.col("mentions").desc(), F.col("leader")])


def rank_positive(loaded: DataFrame, min_mentions: int = MIN_LEADER_MENTIONS) -> DataFrame:
    return ranked(_leaders(loaded, min_mentions), [F.col("sentiment").desc(), F.col("leader")])


def rank_negative(loaded: DataFrame, min_mentions: int = MIN_LEADER_MENTIONS) -> DataFrame:
    return ranked(_leaders(loaded, min_mentions), [F.col("sentiment"), F.col("leader")])


def top_leaders(loaded: DataFrame, k: int = 3) -> DataFrame:
    return top_k(_leaders(loaded), [F.col("mentions").desc(), F.col("leader")], k)


def headline_metrics(loaded: DataFrame) -> DataFrame:
    """One row: posts, distinct countries, distinct leaders, mean score, mean votes.

    One pass over the posts, grouped by the two list columns; names and totals then come from
    that small table, first per name, then over all names.
    """
    cube = loaded.groupBy("country", "leader").agg(
        F.count(F.lit(1)).alias("_posts"),
        F.sum("sentiment_score").alias("_score"),
        F.sum(F.col("upvotes").cast("bigint")).alias("_votes"),
        F.count("upvotes").alias("_voted"),
    )

    def tagged(column: str, kind: str):
        items = F.split(F.coalesce(F.col(column), F.lit("")), ",")
        return F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("entity")))

    entry = F.explode_outer(
        F.concat(
            tagged("country", "country"),
            tagged("leader", "leader"),
            F.array(F.struct(F.lit("total").alias("kind"), F.lit("total").alias("entity"))),
        )
    )
    rows = cube.select(entry.alias("e"), "_posts", "_score", "_votes", "_voted").select("e.*", "*")
    rows = rows.drop("e").withColumn("entity", strip(F.col("entity"))).where("entity != ''")
    name = (
        F.when(F.col("kind") == "country", normalize_country(F.col("entity")))
        .when(F.col("kind") == "leader", normalize_leader(F.col("entity")))
        .otherwise(F.col("entity"))
    )
    total = F.col("kind") == "total"
    names = rows.groupBy("kind", name.alias("entity")).agg(
        *[F.sum(F.when(total, F.col(c))).alias(c) for c in ("_posts", "_score", "_votes", "_voted")]
    )
    return names.agg(
        F.coalesce(F.sum("_posts"), F.lit(0)).alias("total_posts"),
        F.count_if(F.col("kind") == "country").alias("countries"),
        F.count_if(F.col("kind") == "leader").alias("leaders"),
        F.try_divide(F.sum("_score"), F.sum("_posts")).alias("avg_sentiment"),
        F.try_divide(F.sum("_votes"), F.sum("_voted")).alias("avg_upvotes"),
    )


def daily_sentiment(loaded: DataFrame) -> DataFrame:
    return loaded.groupBy("date").agg(
        F.avg("sentiment_score").alias("sentiment"), F.count("sentiment_score").alias("posts")
    )


def sentiment_histogram(loaded: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Posts per equal-width bin of [-1, 1]; empty bins are listed with 0."""
    counts = loaded.groupBy(histogram_bin(F.col("sentiment_score"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("posts")
    )
    width = 2.0 / bins
    all_bins = loaded.sparkSession.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        F.round(F.lit(-1.0) + F.col("bin") * F.lit(width), 6).alias("bin_start"),
        F.coalesce("posts", F.lit(0)).cast("bigint").alias("posts"),
    )


def bin_width(least: float, most: float, bins: int = HISTOGRAM_BINS) -> Decimal:
    """The smallest width 1, 2 or 5 times a power of ten that covers the range with at most `bins`
    bins that begin at its multiples; 1 for a single value."""
    low, high = Decimal(str(least)), Decimal(str(most))
    if low == high:
        return Decimal(1)
    power = Decimal(10) ** (((high - low) / bins).adjusted() - 1)
    while True:
        for step in (1, 2, 5):
            width = power * step
            if _place(high, width) - _place(low, width) < bins:
                return width
        power *= 10


def _place(value: Decimal, width: Decimal) -> int:
    return int((value / width).to_integral_value(ROUND_FLOOR))


def auto_histogram(frame: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows per bin of a width that the data's range decides (`bin_width`): bin_start, bin_end and posts;
    empty bins within the range are listed with 0. Nulls and NaN are left out; without values, no row.

    Two passes: the range, then the counts. Quotients are rounded to nine digits before they are cut, so
    that 0.3 / 0.1 is 3."""
    values = frame.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    found = values.agg(F.min("x").alias("least"), F.max("x").alias("most")).first()
    if found.least is None:
        return values.select(F.col("x").alias("bin_start"), F.col("x").alias("bin_end"), F.lit(0).cast("long").alias("posts")).limit(0)
    width = bin_width(found.least, found.most, bins)
    place = lambda x: F.floor(F.round(x / float(width), 9)).cast("long")
    counts = values.groupBy(place(F.col("x")).alias("bin")).agg(F.count("*").alias("n"))
    ends = [_place(round(Decimal(str(v)) / width, 9), Decimal(1)) for v in (found.least, found.most)]
    every = frame.sparkSession.range(ends[0], ends[1] + 1, 1, 1).select(F.col("id").alias("bin"))
    edge = lambda b: F.round(b * F.lit(float(width)), 9)
    return every.join(F.broadcast(counts), "bin", "left").select(
        edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("posts")
    )


def activity_heatmap(loaded: DataFrame) -> DataFrame:
    return loaded.groupBy("day_of_week", "hour_of_day").agg(
        F.count(F.lit(1)).alias("posts"), F.avg("sentiment_score").alias("sentiment")
    )


def batch_counts(items: DataFrame, strict_bots: bool = False) -> DataFrame:
    """One row: items read, kept and dropped by the author filter, in one pass."""
    bot = is_bot(F.col("author"), strict_bots)
    return items.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(~bot).alias("kept"),
        F.count_if(bot).alias("dropped"),
    )


def post_comment_counts(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count_if(F.col("parent_post_id").isNull()).alias("posts"),
        F.count_if(F.col("parent_post_id").isNotNull()).alias("comments"),
    )


def source_counts(items: DataFrame, mark) -> DataFrame:
    """Per source: items retrieved and items newer than the high-water mark."""
    return items.groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.count_if(F.col("created_utc") > F.lit(mark).cast("timestamp")).alias("new_posts"),
    )


_POST_VIEW = ["post_id", "text", "sentiment_score", "upvotes", "created_utc"]


def top_positive(loaded: DataFrame, k: int = 5) -> DataFrame:
    order = [F.col("sentiment_score").desc(), F.col("post_id")]
    return top_k(loaded.select(*_POST_VIEW), order, k)


def top_negative(loaded: DataFrame, k: int = 5) -> DataFrame:
    return top_k(loaded.select(*_POST_VIEW), [F.col("sentiment_score"), F.col("post_id")], k)


def top_upvoted(loaded: DataFrame, k: int = 5) -> DataFrame:
    voted = loaded.select(*_POST_VIEW).where(F.col("upvotes").isNotNull())
    return top_k(voted, [F.col("upvotes").desc(), F.col("post_id")], k)


def sample_posts(enriched: DataFrame, k: int = 5) -> DataFrame:
    view = enriched.select("post_id", "author", "sentiment_score", "country", "leader")
    return top_k(view, [F.col("post_id")], k)


def display_leaders(loaded: DataFrame) -> DataFrame:
    """Leader table as shown: grouped thousands, two digits for scores, whole votes."""
    return _leaders(loaded).select(
        "leader",
        show_count(F.col("mentions")).alias("mentions"),
        show_score(F.col("sentiment")).alias("sentiment"),
        F.replace(show_count(F.col("avg_upvotes")), F.lit(","), F.lit("")).alias("avg_upvotes"),
    )


def display_posts(loaded: DataFrame) -> DataFrame:
    return loaded.select(
        "post_id",
        show_score(F.col("sentiment_score")).alias("sentiment_score"),
        show_count(F.col("upvotes")).alias("upvotes"),
        show_time(F.col("created_utc")).alias("created_utc"),
    )


def time_features(posts: DataFrame) -> DataFrame:
    ts = F.col("created_utc")
    return posts.select(
        "post_id",
        hour_of_day(ts).alias("hour_of_day"),
        day_of_week(ts).alias("day_of_week"),
        F.to_date(ts).alias("date"),
    )
