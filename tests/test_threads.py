"""Comments of posts with the open items in stored tables."""

import os
from datetime import datetime, timedelta
from urllib.parse import urlparse

import pytest
from pyspark.errors import StreamingQueryException

from tallyvox.operators.threads import comments_only, posts_only
from tallyvox.plans import stream_queries
from tallyvox.plans.stream_queries import land
from tallyvox.schema import POST_SCHEMA
from tallyvox.session import fresh_dir
from tallyvox.streaming import feeds, sinks, threads
from tests.test_quality import post

START = datetime(2024, 1, 1)
SLICES = [
    [],
    [("early", 1.5, "p"), ("q", 0, None)],
    [("p", 1, None), ("p", 1, None), ("in", 2, "p"), ("late", 3.1, "p"), ("edge", 3, "p")],
    [("before", 0.9, "p"), ("of q", 1, "q"), ("twice", 2, "q"), ("twice", 2, "q"), ("orphan", 2, "?")],
    [("a post", 30, None), ("bare", 30, "?")],  # the mark is 6 hours: all but these two is let go
    [("p", 6, None), ("gone", 6.1, "p"), ("q", 6.1, None), ("of q again", 6.1, "q")],
    [("z", 200, None), ("first of z", 200, "z")],
    [("too old", 31, "a post"), ("of z", 201, "z")],
]


def frames(spark):
    def item(name, hours, parent):
        return dict(post(name), created_utc=START + timedelta(hours=hours), parent_post_id=parent)

    return [spark.createDataFrame([item(*row) for row in rows], POST_SCHEMA) for rows in SLICES]


def pairs(rows):
    return sorted((r.post_id, r.parent_post_id) for r in rows.collect())


def local(url):
    return urlparse(url).path


def test_as_the_join_of_two_streams(spark):
    """Both ways, in the same slices; the tables let go of what the join's state lets go of."""
    landing, out, checkpoint, other, path = (fresh_dir(spark, n) for n in ("landing", "out", "checkpoint", "checkpoint", "threads"))

    def join():
        items = feeds.posts_feed(spark, landing, POST_SCHEMA)
        found = feeds.comments_feed(posts_only(items), comments_only(items), "2 hours", "1 day")
        return sinks.append_sink(found.select("post_id", "parent_post_id"), out, checkpoint)

    def tables():
        join().awaitTermination()
        return threads.comments_sink(feeds.posts_feed(spark, landing, POST_SCHEMA), path, other, "2 hours", "1 day")

    land(frames(spark), landing, tables)
    found = pairs(threads.read_comments(spark, path, POST_SCHEMA))
    assert found == pairs(spark.read.parquet(out))
    assert found == [
        ("early", "p"), ("edge", "p"), ("first of z", "z"), ("in", "p"), ("of q", "q"), ("of q again", "q"),
        ("of z", "z"), ("twice", "q"), ("twice", "q"),
    ]
    folders = [f for f, _, names in os.walk(local(path)) if f.endswith("met=false") and names]
    assert sorted(f.split("batch_id=")[1] for f in folders) == [f"{i}/met=false" for i in (6, 7)]
    still = spark.read.schema(POST_SCHEMA).parquet(f"{path}/rows/batch_id=7/met=false")
    assert {r.post_id for r in still.collect()} == {"z"}


def test_a_failed_batch_is_repeated(spark, monkeypatch):
    """Each batch fails once after it is stored and before it is committed: nothing lost, nothing twice."""
    landing, path, checkpoint = (fresh_dir(spark, n) for n in ("landing", "threads", "checkpoint"))
    failed, run = set(), threads.run_batches

    def failing(stream, write, *args, **options):
        def once(batch, batch_id):
            write(batch, batch_id)
            if batch_id not in failed:
                failed.add(batch_id)
                raise RuntimeError("stop")

        return run(stream, once, *args, **options)

    monkeypatch.setattr(threads, "run_batches", failing)

    def start():
        items = feeds.posts_feed(spark, landing, POST_SCHEMA)
        with pytest.raises(StreamingQueryException, match="stop"):
            threads.comments_sink(items, path, checkpoint, "2 hours", "1 day").awaitTermination()
        return threads.comments_sink(items, path, checkpoint, "2 hours", "1 day")

    land(frames(spark)[1:4], landing, start)
    found = pairs(threads.read_comments(spark, path, POST_SCHEMA))
    assert len(failed) == 3
    assert found == [("early", "p"), ("edge", "p"), ("in", "p"), ("of q", "q"), ("twice", "q"), ("twice", "q")]


def test_the_query_has_no_files_for_each_state_partition(spark, sf_dir, monkeypatch):
    """However many shuffle partitions there are, a slice stores its rows in a few files."""
    made = {}

    def noted(session, name):
        made[name] = fresh_dir(session, name)
        return made[name]

    monkeypatch.setattr(stream_queries, "fresh_dir", noted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        stream_queries.stream_threads(spark, sf_dir).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = [f for name in made if name != "landing" for _, _, names in os.walk(local(made[name])) for f in names]
    assert len(files) < 4 * 24
