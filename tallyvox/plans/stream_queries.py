"""The registered stream queries: the given tables arrive as files, are processed to the end,
and the stored result is returned.

Where the result depends on arrival, the events land in four slices, and the stream is started
anew for each slice from its checkpoint, so batch limits do not depend on file sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyvox.operators.enrich import enrich
from tallyvox.plans import models, reports
from tallyvox.plans.adapters import POSTS_DOCUMENTS, TABLE_SCHEMAS, posts_events, table
from tallyvox.plans.queries import Query, _merged_view, _upsert_pair, six, stamp
from tallyvox.schema import POST_SCHEMA
from tallyvox.session import fresh_dir, pin_utc
from tallyvox.sources.keyed_table import compact, publish_snapshot, read_current, read_snapshot, write_log_batch
from tallyvox.sources.landed import cursor_token, read_listings
from tallyvox.sources.posts import load_posts
from tallyvox.streaming import admission, feeds, recovery, sinks, threads
from tallyvox.streaming.collector import collect

STREAM_QUERIES: dict[str, Query] = {}


def stream_query(build: Query) -> Query:
    STREAM_QUERIES[build.__name__] = build
    return build


def time_slice(created: str = "created_utc"):
    """Slice 0 to 3 by day of the month: the events in order of time."""
    return F.least(F.lit(3), F.floor((F.dayofmonth(created) - 1) / 8).cast("int"))


def land(slices: Iterable[DataFrame], landing: str, start: Callable[[], StreamingQuery]) -> None:
    """Write each slice below `landing` and let a fresh run of the stream take it."""
    for piece in slices:
        piece.write.mode("append").parquet(landing)
        start().awaitTermination()


def _in_time_order(posts: DataFrame) -> list[DataFrame]:
    return [posts.where(time_slice() == i) for i in range(4)]


def _posts_feed(spark: SparkSession, landing: str, **options: str) -> DataFrame:
    return feeds.posts_feed(spark, landing, POST_SCHEMA, **options)


@stream_query
def stream_enrich(spark, sf_dir):
    """The documents table read as a stream, enriched and appended with exactly-once files."""
    pin_utc(spark)
    out, checkpoint = fresh_dir(spark, "enriched"), fresh_dir(spark, "checkpoint")
    # As a pattern, the path may be one file or a folder of files.
    feed = feeds.posts_feed(spark, f"{sf_dir}/documents.parque[t]", TABLE_SCHEMAS["documents"])
    posts = spark.sql(POSTS_DOCUMENTS, documents=feed)
    enriched = enrich(
        posts,
        models.language_model(spark, sf_dir),
        models.LOAD_TIME,
        countries=models.KEYWORDS,
        leaders=models.LEADER_WORDS,
    ).drop("text")
    sinks.append_sink(enriched, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select(
        "post_id", "author", "sentiment_score", "message_language", "country", "leader",
        stamp(F.col("last_processed")).alias("last_processed"),
    )


@stream_query
def stream_watermark(spark, sf_dir):
    """Four interleaved slices: after the first, only rows past the mark are taken."""
    landing, out, checkpoint = (fresh_dir(spark, n) for n in ("landing", "out", "checkpoint"))
    posts = posts_events(spark, sf_dir)
    number = F.col("post_id").cast("bigint") % 4

    def start():
        feed = feeds.on_time(_posts_feed(spark, landing))
        return sinks.append_sink(feed.select("post_id", "subreddit", "created_utc"), out, checkpoint)

    land([posts.where(number == i) for i in range(4)], landing, start)
    return spark.read.parquet(out).select(
        "post_id", "subreddit", stamp(F.col("created_utc")).alias("created_utc")
    )


@stream_query
def stream_source_cursor(spark, sf_dir):
    landing, out, checkpoint = (fresh_dir(spark, n) for n in ("landing", "out", "checkpoint"))

    def start():
        cursor = feeds.source_cursor(_posts_feed(spark, landing))
        return sinks.changes_sink(cursor, out, checkpoint)

    land(_in_time_order(posts_events(spark, sf_dir)), landing, start)
    latest = sinks.latest_changes(spark, out, ["subreddit"])
    return latest.withColumns(
        {"after": cursor_token(F.col("post_id")), "created_utc": stamp(F.col("created_utc"))}
    )


@stream_query
def stream_late_split(spark, sf_dir):
    """Clicks with many votes arrive one slice late."""
    landing, out, checkpoint = (fresh_dir(spark, n) for n in ("landing", "out", "checkpoint"))
    delayed = (F.col("subreddit") == "click") & (F.col("upvotes") > 40)
    arrives = F.least(F.lit(3), time_slice() + F.when(delayed, 1).otherwise(0))
    posts = posts_events(spark, sf_dir)

    def start():
        return sinks.late_split_sink(_posts_feed(spark, landing), out, checkpoint)

    land([posts.where(arrives == i) for i in range(4)], landing, start)
    return sinks.read_split(spark, out).select("post_id", "batch_id", "late")


@stream_query
def stream_dedupe(spark, sf_dir):
    """Every slice holds some posts twice and sends some of the last slice again."""
    landing, out, checkpoint = (fresh_dir(spark, n) for n in ("landing", "out", "checkpoint"))
    posts = posts_events(spark, sf_dir)
    again = posts.where(F.col("upvotes") > 40)
    slices = [
        posts.where(time_slice() == i)
        .unionByName(again.where(time_slice() == i))
        .unionByName(again.where(time_slice() == i - 1))
        for i in range(4)
    ]

    def start():
        feed = feeds.on_time(_posts_feed(spark, landing))
        return sinks.append_sink(feed.select("post_id", "subreddit", "created_utc"), out, checkpoint)

    land(slices, landing, start)
    return spark.read.parquet(out).select(
        "post_id", "subreddit", stamp(F.col("created_utc")).alias("created_utc")
    )


@stream_query
def stream_upsert(spark, sf_dir):
    """A stream that starts on a published snapshot: half of the base is there before it."""
    landing, root, checkpoint = (fresh_dir(spark, n) for n in ("landing", "table", "checkpoint"))
    base, updates = _upsert_pair(spark, sf_dir)
    half = F.col("post_id").cast("bigint") % 4 < 2
    publish_snapshot(base.where(half), root, 0)

    def start():
        return sinks.upsert_sink(_posts_feed(spark, landing), root, checkpoint)

    land([base.where(~half), updates], landing, start)
    return _merged_view(read_current(spark, root))


@stream_query
def stream_resume(spark, sf_dir):
    """The stream goes on with a new checkpoint, whose batches count from 0 again; the log is
    folded in between."""
    root = fresh_dir(spark, "table")
    for piece in _upsert_pair(spark, sf_dir):
        landing, checkpoint = fresh_dir(spark, "landing"), fresh_dir(spark, "checkpoint")
        piece.write.parquet(landing)
        sinks.upsert_sink(_posts_feed(spark, landing), root, checkpoint).awaitTermination()
        compact(spark, root)
    return _merged_view(read_current(spark, root))


@stream_query
def stream_moved_days(spark, sf_dir):
    """Later copies that name another day of creation than the first: each key stays on its day."""
    landing, root, checkpoint = (fresh_dir(spark, n) for n in ("landing", "table", "checkpoint"))
    base, updates = _upsert_pair(spark, sf_dir)
    publish_snapshot(base, root, 0)
    moved = F.col("created_utc") + F.make_interval(days=F.lit(1))
    updates.withColumn("created_utc", moved).write.parquet(landing)
    sinks.upsert_sink(_posts_feed(spark, landing), root, checkpoint).awaitTermination()
    compact(spark, root)
    return read_snapshot(spark, root).select("post_id", "upvotes", stamp(F.col("created_utc")).alias("created_utc"))


@stream_query
def stream_collect(spark, sf_dir):
    """The whole job: landed listings and replies, a few files at a time, to the keyed table."""
    landing, root, checkpoint = (fresh_dir(spark, n) for n in ("landing", "table", "checkpoint"))
    n = F.col("event_id")
    author = F.when(n % 17 == 0, "AutoModerator").otherwise(F.concat(F.lit("user_"), "user_id"))
    data = F.struct(
        n.cast("string").alias("id"),
        author.alias("author"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("created_utc"),
        F.col("event_type").alias("title"),
        F.floor("value").cast("int").alias("score"),
    )
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("subreddit"),
        F.struct(F.array(F.struct(F.lit("t3").alias("kind"), data.alias("data"))).alias("children")).alias("data"),
    )
    events.repartition(6, "data").write.partitionBy("subreddit").json(f"{landing}/listings")
    comment = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("role").alias("author"),
        (F.lit(1_700_000_000) + F.col("turn")).cast("double").alias("created_utc"),
        F.concat(F.lit("turn "), "turn").alias("body"),
        F.lit("talk").alias("subreddit"),
        F.col("turn").alias("score"),
    )
    part = F.struct(F.array(F.struct(F.lit("t1").alias("kind"), comment.alias("data"))).alias("children"))
    empty = F.lit('{"data":{"children":[]}}')
    replies = table(spark, sf_dir, "conversations").where("turn > 0").select(
        F.pmod("conv_id", F.lit(8)).cast("string").alias("post_id"),
        F.concat(F.lit("["), empty, F.lit(","), F.to_json(F.struct(part.alias("data"))), F.lit("]")).alias("value"),
    )
    replies.write.partitionBy("post_id").text(f"{landing}/replies")
    job = collect(
        spark, landing, root, checkpoint, models.TINY_LANGUAGES, interval=None, files_per_batch=16, compact_every=3
    )
    job.awaitTermination()
    return read_current(spark, root).select(
        "post_id", "author", "text", "subreddit", "upvotes", "num_comments", "parent_post_id",
        "sentiment_score", "message_language", F.col("last_processed").isNotNull().alias("processed"),
    )


@stream_query
def stream_restart(spark, sf_dir):
    """A batch fails after its write; the restarted stream repeats it without loss or doubles."""
    landing, root, checkpoint = (fresh_dir(spark, n) for n in ("landing", "table", "checkpoint"))
    failures = iter([True])

    def write(batch: DataFrame, batch_id: int) -> None:
        write_log_batch(batch, root, batch_id)
        if batch_id == 1 and next(failures, False):
            raise RuntimeError("stopped after the write")

    def start():
        return sinks.run_batches(_posts_feed(spark, landing), write, checkpoint)

    for piece in _upsert_pair(spark, sf_dir):
        piece.write.mode("append").parquet(landing)
        try:
            start().awaitTermination()
        except StreamingQueryException:
            start().awaitTermination()
    return _merged_view(read_current(spark, root))


@stream_query
def stream_daily_trend(spark, sf_dir):
    landing, out, checkpoint = (fresh_dir(spark, n) for n in ("landing", "out", "checkpoint"))

    def start():
        trend = feeds.daily_trend(load_posts(_posts_feed(spark, landing)))
        return sinks.changes_sink(trend, out, checkpoint)

    land(_in_time_order(posts_events(spark, sf_dir)), landing, start)
    latest = sinks.latest_changes(spark, out, ["date"])
    return latest.select("date", six("sentiment"), "posts")


@stream_query
def stream_clean_source(spark, sf_dir):
    """Listing files are archived once the batch that read them is committed."""
    landing, out, checkpoint, archive = (
        fresh_dir(spark, n) for n in ("landing", "out", "checkpoint", "archive")
    )
    events = table(spark, sf_dir, "events")
    node = F.struct(
        F.lit("t3").alias("kind"),
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.concat(F.lit("user_"), "user_id").alias("author"),
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("created_utc"),
            F.col("event_type").alias("title"),
            F.floor("value").cast("int").alias("score"),
        ).alias("data"),
    )
    # One listing page per post keeps the feed free of any grouping.
    pages = events.select(
        "ts", F.col("event_type").alias("subreddit"), F.struct(F.array(node).alias("children")).alias("data")
    )

    def start():
        posts = read_listings(
            spark, landing, stream=True, cleanSource="archive", sourceArchiveDir=archive
        )
        return sinks.append_sink(posts, out, checkpoint)

    for i in range(4):
        pages.where(time_slice("ts") == i).drop("ts").write.mode("append").partitionBy(
            "subreddit"
        ).json(landing)
        start().awaitTermination()
    posts = spark.read.schema(POST_SCHEMA).parquet(out)
    # Spark archives the files of a batch when the next one has begun: all but those of the last.
    archived = spark.read.option("recursiveFileLookup", True).text(archive).count()
    left = spark.read.option("recursiveFileLookup", True).text(landing).count()
    return reports.source_counts(posts, models.MARK).withColumns(
        {"some_archived": F.lit(archived > 0), "none_lost": F.lit(archived + left == events.count())}
    )


@stream_query
def stream_threads(spark, sf_dir):
    """Comments within an hour of their post; some comments come a slice before it, some a slice after."""
    landing, path, checkpoint = (fresh_dir(spark, n) for n in ("landing", "threads", "checkpoint"))
    delayed = F.col("upvotes") > 40
    arrives = F.least(F.lit(3), time_slice() + F.when(delayed, 1).otherwise(0))
    items = posts_events(spark, sf_dir)

    def start():
        feed = _posts_feed(spark, landing).select("post_id", "parent_post_id", "created_utc")
        return threads.comments_sink(feed, path, checkpoint, "1 hour", "10 days")

    land([items.where(arrives == i) for i in range(4)], landing, start)
    found = StructType([POST_SCHEMA["post_id"], POST_SCHEMA["parent_post_id"]])
    return threads.read_comments(spark, path, found)


@stream_query
def stream_fair(spark, sf_dir):
    """Sources with a quota, three at a time: at the end all posts are in, each once."""
    landing, path, checkpoint = (fresh_dir(spark, n) for n in ("landing", "fair", "checkpoint"))
    posts = posts_events(spark, sf_dir)
    quota = -(-posts.count() // 20)

    def start():
        return admission.fair_sink(_posts_feed(spark, landing), path, checkpoint, quota, sources=3)

    land(_in_time_order(posts), landing, start)
    while not admission.read_backlog(spark, path).isEmpty():  # cycles in which nothing arrives
        land([posts.limit(0)], landing, start)
    admitted = admission.read_admitted(spark, path)
    over = admitted.groupBy("cycle", "subreddit").agg(F.count("*").alias("n")).where(F.col("n") > quota)
    in_turn = over.join(admitted, ["cycle", "subreddit"], "right")
    return in_turn.select("post_id", "subreddit", F.col("n").isNull().alias("within_quota"))


@stream_query
def stream_state_check(spark, sf_dir):
    """The state in the checkpoints of restarted streams against what they have stored."""
    posts, found = posts_events(spark, sf_dir), []
    for name in ("cursor", "dedupe"):
        landing, out, checkpoint = (fresh_dir(spark, n) for n in ("landing", "out", "checkpoint"))

        def start():
            feed = _posts_feed(spark, landing)
            if name == "cursor":
                return sinks.changes_sink(feeds.source_cursor(feed), out, checkpoint)
            return sinks.append_sink(feeds.on_time(feed).select("post_id", "created_utc"), out, checkpoint)

        land(_in_time_order(posts), landing, start)
        if name == "cursor":
            latest = sinks.latest_changes(spark, out, ["subreddit"])
            rows = recovery.cursor_differences(spark, checkpoint, latest)
        else:
            rows = recovery.dedupe_differences(spark, checkpoint, spark.read.parquet(out))
        found.append(rows.select(F.lit(name).alias("state"), "in_state", "differing"))
    return found[0].union(found[1])
