import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyvox.operators.language import LanguageModel
from tallyvox.plans.adapters import posts_events
from tallyvox.plans.stream_queries import land
from tallyvox.schema import POST_SCHEMA
from tallyvox.session import fresh_dir
from tallyvox.sources.keyed_table import current_version, read_current
from tallyvox.sources.landed import read_listings
from tallyvox.streaming import feeds, sinks
from tallyvox.streaming.collector import collect
from tests.test_landed import PAGE, REPLY
from tests.test_quality import post

MODEL = LanguageModel(("de", "en"), {"the": (-9, -1), "der": (-1, -9)})


def dirs(spark, *names):
    return [fresh_dir(spark, n) for n in names]


def landing_zone(tmp_path, page=PAGE, name="p.json"):
    listing = tmp_path / "listings" / "subreddit=news"
    reply = tmp_path / "replies" / "post_id=a"
    listing.mkdir(parents=True, exist_ok=True)
    reply.mkdir(parents=True, exist_ok=True)
    (listing / name).write_text(json.dumps(page) + "\n")
    (reply / name).write_text(json.dumps(REPLY) + "\n")


def test_collector_end_to_end(spark, tmp_path):
    """Landed JSON to the table; a second page changes votes only; an idle cycle is a success."""
    table, checkpoint = dirs(spark, "table", "checkpoint")

    def cycle():
        query = collect(spark, str(tmp_path), table, checkpoint, MODEL, interval=None)
        query.awaitTermination()
        return query

    landing_zone(tmp_path)
    counts = cycle().recentProgress[0]["observedMetrics"]["batch"]
    assert counts.asDict() == {"items": 5, "posts": 3, "comments": 2, "kept": 4}
    first = {r.post_id: r for r in read_current(spark, table).collect()}
    assert set(first) == {"a", "b", "k1", "k3"}  # "c" has a null author
    assert first["k1"].parent_post_id == "a" and first["a"].message_language == "en"
    changed = json.loads(json.dumps(PAGE))
    changed["data"]["children"][0]["data"].update(score=50, selftext="edited")
    landing_zone(tmp_path, changed, "q.json")
    cycle()
    cycle()
    second = {r.post_id: r for r in read_current(spark, table).collect()}
    assert set(second) == set(first)
    assert (second["a"].upvotes, second["a"].text) == (50, "body")


def test_collector_compacts(spark, tmp_path):
    table, checkpoint = dirs(spark, "table", "checkpoint")
    versions = []
    for i in range(3):
        page = json.loads(json.dumps(PAGE))
        page["data"]["children"][0]["data"]["score"] = i
        landing_zone(tmp_path, page, f"{i}.json")
        collect(
            spark, str(tmp_path), table, checkpoint, MODEL, interval=None, compact_every=2
        ).awaitTermination()
        versions.append(current_version(spark, table))
    assert versions[0] is None and versions[1] == versions[2]
    assert list(versions[1].folded.values()) == [1]
    rows = {r.post_id: r.upvotes for r in read_current(spark, table).collect()}
    assert rows == {"a": 2, "b": 0, "k1": -3, "k3": 0}


def test_processing_time_trigger(spark, tmp_path):
    table, checkpoint = dirs(spark, "table", "checkpoint")
    landing_zone(tmp_path)
    query = collect(spark, str(tmp_path), table, checkpoint, MODEL, interval="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert read_current(spark, table).count() == 4


def test_failed_batch_is_repeated(spark, sf_dir):
    """Stop after the write and before the commit: nothing lost, nothing twice."""
    landing, out, checkpoint = dirs(spark, "landing", "out", "checkpoint")
    posts = posts_events(spark, sf_dir)
    posts.write.parquet(landing)
    feed = lambda: feeds.posts_feed(spark, landing, POST_SCHEMA)

    def broken(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        raise RuntimeError("stop")

    with pytest.raises(Exception, match="stop"):
        sinks.run_batches(feed(), broken, checkpoint).awaitTermination()
    sinks.changes_sink(feed().groupBy("post_id").count(), *dirs(spark, "o", "c")).awaitTermination()

    def whole(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    sinks.run_batches(feed(), whole, checkpoint).awaitTermination()
    assert spark.read.parquet(out).select("post_id").distinct().count() == posts.count()
    assert spark.read.parquet(out).count() == posts.count()


def at(key, minute, **values):
    row = post(key, **values)
    row["created_utc"] = datetime(2024, 1, 1 + minute // 1440, minute % 1440 // 60, minute % 60)
    return row


def test_late_rows_and_repeats(spark):
    slices = [
        [at("a", 0), at("b", 120)],
        [at("b", 120), at("late", 59), at("edge", 60), at("ok", 61)],
        [at("c", 300), at("ok", 61)],
        [at("late2", 200), at("d", 241)],
    ]
    frames = [spark.createDataFrame(s, POST_SCHEMA) for s in slices]
    landing, out, checkpoint = dirs(spark, "landing", "out", "checkpoint")

    def start():
        feed = feeds.on_time(feeds.posts_feed(spark, landing, POST_SCHEMA))
        return sinks.append_sink(feed.select("post_id"), out, checkpoint)

    land(frames, landing, start)
    kept = sorted(r.post_id for r in spark.read.parquet(out).collect())
    assert kept == ["a", "b", "c", "d", "ok"]

    landing, out, checkpoint = dirs(spark, "landing", "out", "checkpoint")

    def split():
        return sinks.late_split_sink(feeds.posts_feed(spark, landing, POST_SCHEMA), out, checkpoint)

    land(frames, landing, split)
    rows = sinks.read_split(spark, out)
    late = {(r.post_id, r.batch_id) for r in rows.where("late").collect()}
    assert late == {("late", 1), ("edge", 1), ("late2", 3)}
    assert rows.count() == sum(map(len, slices))


def test_clean_source_archives_committed_files(spark, tmp_path):
    landing_zone(tmp_path)
    out, checkpoint = dirs(spark, "out", "checkpoint")
    archive = tmp_path / "archive"

    def run():
        posts = read_listings(
            spark, str(tmp_path / "listings"), stream=True, cleanSource="archive", sourceArchiveDir=str(archive)
        )
        sinks.append_sink(posts, out, checkpoint).awaitTermination()

    run()
    landing_zone(tmp_path, name="q.json")
    run()
    landing_zone(tmp_path, name="r.json")
    run()
    archived = {p.name for p in archive.rglob("*.json")}
    assert "p.json" in archived
    assert spark.read.schema(POST_SCHEMA).parquet(out).count() == 9


def test_empty_feed_is_a_success(spark, tmp_path):
    out, checkpoint = dirs(spark, "out", "checkpoint")
    feed = feeds.posts_feed(spark, str(tmp_path), POST_SCHEMA)
    query = sinks.append_sink(feed, out, checkpoint)
    query.awaitTermination()
    assert query.exception() is None


def test_trend_and_cursor_follow_the_batch_result(spark, sf_dir):
    posts = posts_events(spark, sf_dir)
    landing, out, checkpoint = dirs(spark, "landing", "out", "checkpoint")
    posts.repartition(6).write.parquet(landing)
    feed = feeds.posts_feed(spark, landing, POST_SCHEMA, maxFilesPerTrigger="2")
    sinks.changes_sink(feeds.source_cursor(feed), out, checkpoint).awaitTermination()
    found = sinks.latest_changes(spark, out, ["subreddit"])
    newest = posts.groupBy("subreddit").agg(F.max(F.struct("created_utc", "post_id")).alias("n"))
    assert sorted(found.select("subreddit", "post_id").collect()) == sorted(
        newest.select("subreddit", "n.post_id").collect()
    )
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3


def test_state_keeps_the_configured_partitions(spark, sf_dir):
    """However few cores there are at the start."""
    landing, out, checkpoint = dirs(spark, "landing", "out", "checkpoint")
    posts_events(spark, sf_dir).limit(50).write.parquet(landing)
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "9")
    try:
        feed = feeds.posts_feed(spark, landing, POST_SCHEMA)
        sinks.changes_sink(feeds.source_cursor(feed), out, checkpoint).awaitTermination()
        assert spark.conf.get(name) == "9"
    finally:
        spark.conf.set(name, before)
    offsets = spark.read.text(f"{checkpoint}/offsets/0").collect()
    assert any('"spark.sql.shuffle.partitions":"9"' in r.value for r in offsets)


def test_a_new_checkpoint_is_a_new_stream(spark, sf_dir):
    table = fresh_dir(spark, "table")
    posts = posts_events(spark, sf_dir)
    for part in range(2):
        landing, checkpoint = dirs(spark, "landing", "checkpoint")
        posts.where(F.col("post_id").cast("int") % 2 == part).write.parquet(landing)
        feed = feeds.posts_feed(spark, landing, POST_SCHEMA)
        sinks.upsert_sink(feed, table, checkpoint).awaitTermination()
    assert read_current(spark, table).count() == posts.count()
