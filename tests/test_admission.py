"""Fair admission, threads of streams and the state in checkpoints."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyvox.operators.threads import comments_only, posts_only
from tallyvox.plans.stream_queries import land
from tallyvox.schema import POST_SCHEMA
from tallyvox.session import fresh_dir
from tallyvox.streaming import admission, feeds, recovery, sinks
from tests.test_quality import post

START = datetime(2024, 1, 1)


def item(name, hours=0.0, source="a", parent=None):
    row = dict(post(name), created_utc=START + timedelta(hours=hours), subreddit=source, parent_post_id=parent)
    return row


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), POST_SCHEMA)


def feed(spark, landing):
    return feeds.posts_feed(spark, landing, POST_SCHEMA)


def simulate(slices, quota, sources):
    """Cycles of admitted ids, until nothing waits."""
    waiting, cycles, at = [], [], 0
    while at < len(slices) or waiting:
        waiting += [(at, r["created_utc"], r["post_id"], r["subreddit"]) for r in (slices[at] if at < len(slices) else [])]
        oldest = {}
        for row in waiting:
            oldest[row[3]] = min(row[0], oldest.get(row[3], row[0]))
        turn = sorted(oldest, key=lambda s: (oldest[s], s))[:sources]
        taken = [row for s in turn for row in sorted(r for r in waiting if r[3] == s)[:quota]]
        waiting = [row for row in waiting if row not in taken]
        cycles.append({row[2] for row in taken})
        at += 1
    return cycles


@pytest.mark.parametrize("sources", [None, 2])
def test_quotas_backlog_and_restarts(spark, monkeypatch, sources):
    """A failure after the admitted rows are written, and one after the backlog is: nothing lost or doubled."""
    names = [[f"{s}{i}" for s, n in zip("abc", sizes) for i in range(10 * k, 10 * k + n)] for k, sizes in enumerate([(9, 2, 0), (0, 1, 3), (2, 0, 1)])]
    slices = [[item(n, hours=(hash(n[1:]) % 7), source=n[0]) for n in part] for part in names]
    want = simulate(slices, 3, sources or 99)
    landing, path, checkpoint = (fresh_dir(spark, n) for n in ("landing", "fair", "checkpoint"))
    failing = iter([True, False, True])

    def start():
        return admission.fair_sink(feed(spark, landing), path, checkpoint, 3, sources)

    real = sinks.run_batches

    def run_batches(stream, write, *args, **kwargs):
        def shaky(batch, batch_id):
            write(batch, batch_id)
            if next(failing, False):
                raise RuntimeError("stopped after the write")

        return real(stream, shaky, *args, **kwargs)

    monkeypatch.setattr(admission, "run_batches", run_batches)
    for rows in slices + [[]] * (len(want) - len(slices)):
        frame(spark, *rows).write.mode("append").parquet(landing)
        try:
            start().awaitTermination()
        except StreamingQueryException:
            start().awaitTermination()
    found = admission.read_admitted(spark, path).collect()
    assert [{r.post_id for r in found if r.cycle == c} for c in range(len(want))] == want
    assert len(found) == sum(map(len, names)) and admission.read_backlog(spark, path).isEmpty()


def test_a_hot_source_is_limited_before_the_shuffle(spark):
    waiting = frame(spark, item("x")).withColumn(admission.SINCE, F.lit(0).cast("long"))
    admitted, rest = admission.admit(waiting, 5)
    text = admitted._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "Window [" not in rest._jdf.queryExecution().executedPlan().toString().split("LeftAnti")[0]


def test_comments_before_their_post_and_after_the_bound(spark):
    landing, out, checkpoint = (fresh_dir(spark, n) for n in ("landing", "out", "checkpoint"))
    slices = [
        [item("early", 1.5, parent="p"), item("q", 0)],
        [item("p", 1), item("p", 1), item("in", 2, parent="p"), item("late", 3.1, parent="p"), item("edge", 3, parent="p")],
        [item("before", 0.9, parent="p"), item("of q", 1, parent="q"), item("orphan", 2, parent="?")],
        [item("z", 200), item("first of z", 200, parent="z")],  # the mark, the lesser of both sides', passes all of it
        [item("too old", 1, parent="q"), item("of z", 201, parent="z")],
    ]

    def start():
        items = feed(spark, landing)
        found = feeds.comments_feed(posts_only(items), comments_only(items), "2 hours", "1 day")
        return sinks.append_sink(found.select("post_id", "parent_post_id"), out, checkpoint)

    land([frame(spark, *rows) for rows in slices], landing, start)
    found = sorted((r.post_id, r.parent_post_id) for r in spark.read.parquet(out).collect())
    assert found == [("early", "p"), ("edge", "p"), ("first of z", "z"), ("in", "p"), ("of q", "q"), ("of z", "z")]


def test_differences_are_seen(spark):
    """The state of a cursor and of a dedupe, against what was stored and against something else."""
    for name in ("cursor", "dedupe"):
        landing, out, checkpoint = (fresh_dir(spark, n) for n in ("landing", "out", "checkpoint"))

        def start():
            if name == "cursor":
                return sinks.changes_sink(feeds.source_cursor(feed(spark, landing)), out, checkpoint)
            return sinks.append_sink(feeds.on_time(feed(spark, landing)), out, checkpoint)

        land([frame(spark, item("a1", 1), item("b1", 4.5, "b")), frame(spark, item("a2", 5), item("a2", 5))], landing, start)
        if name == "cursor":
            latest = sinks.latest_changes(spark, out, ["subreddit"])
            check = lambda rows: recovery.cursor_differences(spark, checkpoint, rows).first()
        else:
            latest = spark.read.parquet(out)
            check = lambda rows: recovery.dedupe_differences(spark, checkpoint, rows).first()
        assert tuple(check(latest)) == (2, 0)
        assert tuple(check(latest.where("post_id != 'b1'"))) == (2, 1)
        moved = latest.withColumn("post_id", F.when(F.col("post_id") == "b1", "zz").otherwise(F.col("post_id")))
        assert tuple(check(moved)) == (2, 2)
