from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyvox.operators import merge
from tallyvox.schema import POST_SCHEMA
from tallyvox.sources import keyed_table
from tallyvox.session import discard, fresh_dir
from tests.test_quality import post

DAYS = [datetime(2024, 1, d) for d in range(1, 9)]


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), POST_SCHEMA)


def view(merged):
    return {r.post_id: (r.upvotes, r.text, r.last_processed) for r in merged.collect()}


@pytest.mark.parametrize("small", [True, False, None])
def test_upsert(spark, small):
    base = frame(
        spark,
        post("k", upvotes=1, text="a", last_processed=DAYS[0]),
        post("same", upvotes=4, text="s", last_processed=DAYS[0]),
        post("null", upvotes=4, text="n", last_processed=DAYS[0]),
    )
    updates = frame(
        spark,
        post("k", upvotes=5, text="b", last_processed=DAYS[1]),
        post("new", upvotes=1, text="x", last_processed=DAYS[1]),
        post("new", upvotes=2, text="y", last_processed=DAYS[2]),
        post("null", upvotes=None, text="z", last_processed=DAYS[1]),
    )
    merged = merge.upsert(base, updates, broadcast_updates=small)
    expected = {
        "k": (5, "a", DAYS[1]),
        "same": (4, "s", DAYS[0]),
        "new": (2, "y", DAYS[2]),
        "null": (None, "n", DAYS[1]),
    }
    assert view(merged) == expected
    assert merged.columns == base.columns
    assert view(merge.upsert(merged, updates, broadcast_updates=small)) == expected


def test_fold_log_equals_repeated_upserts(spark):
    batches = [
        [post("a", upvotes=1, text="1", last_processed=DAYS[0]), post("b", upvotes=1, text="1")],
        [post("a", upvotes=None, text="2", last_processed=DAYS[1])],
        [post("b", upvotes=3, text="3", last_processed=DAYS[2]), post("c", upvotes=1, text="3")],
    ]
    merged = frame(spark, *batches[0])
    for batch in batches[1:]:
        merged = merge.upsert(merged, frame(spark, *batch))
    root = fresh_dir(spark, "table")
    assert keyed_table.read_current(spark, root) is None
    for i, batch in enumerate(batches):
        keyed_table.write_log_batch(frame(spark, *batch), root, i)
        keyed_table.write_log_batch(frame(spark, *batch), root, i)
    expected = view(merged)
    assert view(keyed_table.read_current(spark, root)) == expected
    assert keyed_table.compact(spark, root) and not keyed_table.compact(spark, root)
    assert keyed_table.current_version(spark, root).folded == {"stream": 2}
    assert view(keyed_table.read_current(spark, root)) == expected
    keyed_table.write_log_batch(frame(spark, post("c", upvotes=9, text="4")), root, 3)
    assert view(keyed_table.read_current(spark, root))["c"][:2] == (9, "3")
    assert keyed_table.read_current(spark, root).schema.fieldNames() == POST_SCHEMA.fieldNames()


def test_snapshots_are_published_once(spark):
    root = fresh_dir(spark, "table")
    assert keyed_table.read_snapshot(spark, root) is None
    keyed_table.publish_snapshot(frame(spark, post("a", upvotes=1)), root, 1)
    keyed_table.publish_snapshot(frame(spark, post("a", upvotes=2)), root, 1)
    assert view(keyed_table.read_snapshot(spark, root))["a"][0] == 1
    keyed_table.publish_snapshot(frame(spark, post("a", upvotes=3)), root, 2)
    keyed_table.publish_snapshot(frame(spark, post("a", upvotes=4)), root, 1)
    assert view(keyed_table.read_snapshot(spark, root))["a"][0] == 3


def test_failed_snapshot_is_not_published(spark):
    root = fresh_dir(spark, "table")
    keyed_table.publish_snapshot(frame(spark, post("a", upvotes=1)), root, 1)
    broken = frame(spark, post("a", upvotes=2)).selectExpr("*", "raise_error('stop') AS e")
    with pytest.raises(Exception, match="stop"):
        keyed_table.publish_snapshot(broken, root, 2)
    assert keyed_table.current_version(spark, root).folded == {"snapshots": 1}
    assert view(keyed_table.read_snapshot(spark, root))["a"][0] == 1


def rows_of(spark, *ids, votes=1, day=0):
    return frame(spark, *[dict(post(i, upvotes=votes), created_utc=DAYS[day]) for i in ids])


def ids_in(table):
    return sorted(r.post_id for r in table.collect())


def test_batches_of_any_stream_join_a_published_snapshot(spark):
    """Batch numbers of a stream say nothing about versions or about other streams."""
    root = fresh_dir(spark, "table")
    keyed_table.publish_snapshot(rows_of(spark, "a", "b"), root, 0)
    keyed_table.write_log_batch(rows_of(spark, "c"), root, 0, "one")
    keyed_table.write_log_batch(rows_of(spark, "d"), root, 0, "two")
    assert ids_in(keyed_table.read_current(spark, root)) == ["a", "b", "c", "d"]
    assert keyed_table.compact(spark, root)
    keyed_table.write_log_batch(rows_of(spark, "e"), root, 0, "three")
    keyed_table.write_log_batch(rows_of(spark, "ignored"), root, 0, "two")  # that batch is stored
    keyed_table.write_log_batch(rows_of(spark, "a", votes=9), root, 1, "one")
    assert ids_in(keyed_table.read_current(spark, root)) == ["a", "b", "c", "d", "e"]
    assert view(keyed_table.read_current(spark, root))["a"][0] == 9


def test_an_unfinished_batch_is_neither_read_nor_folded(spark):
    root = fresh_dir(spark, "table")
    keyed_table.write_log_batch(rows_of(spark, "a"), root, 0)
    broken = rows_of(spark, "b").selectExpr("*").withColumn("text", F.expr("raise_error('stop')"))
    with pytest.raises(Exception, match="stop"):
        keyed_table.write_log_batch(broken, root, 1)
    rows_of(spark, "half").write.parquet(f"{root}/log/someone-still-writes")
    assert ids_in(keyed_table.read_current(spark, root)) == ["a"]
    keyed_table.compact(spark, root)
    keyed_table.write_log_batch(rows_of(spark, "b", "c"), root, 1)  # the repeat completes it
    assert ids_in(keyed_table.read_current(spark, root)) == ["a", "b", "c"]
    keyed_table.compact(spark, root)
    assert ids_in(keyed_table.read_snapshot(spark, root)) == ["a", "b", "c"]


def test_other_days_are_neither_read_nor_written(spark):
    root = fresh_dir(spark, "table")
    keyed_table.publish_snapshot(rows_of(spark, "a").union(rows_of(spark, "b", day=3)).union(rows_of(spark, "c", day=5)), root, 0)
    before = keyed_table.current_version(spark, root).days
    discard(spark, before["2024-01-01"])  # a day that cannot be read any more
    keyed_table.transfer(rows_of(spark, "b", votes=7, day=3).union(rows_of(spark, "d", day=6)), root, 0)
    after = keyed_table.current_version(spark, root).days
    assert {d for d in before if before[d] == after[d]} == {"2024-01-01", "2024-01-06"}
    assert set(after) - set(before) == {"2024-01-07"}
    late = keyed_table.read_current(spark, root, since=DAYS[3].date())
    assert {k: v[0] for k, v in view(late).items()} == {"b": 7, "c": 1, "d": 1}
    keyed_table.write_log_batch(rows_of(spark, "old").union(rows_of(spark, "new", day=4)), root, 1, "transfer")
    assert ids_in(keyed_table.read_current(spark, root, since=DAYS[3].date())) == ["b", "c", "d", "new"]


def test_two_folds_at_once_lose_nothing(spark):
    """The second fold starts before the first has published."""
    root = fresh_dir(spark, "table")
    keyed_table.publish_snapshot(rows_of(spark, "a"), root, 0)
    before = keyed_table.current_version(spark, root)
    keyed_table.write_log_batch(rows_of(spark, "b"), root, 0)
    keyed_table.compact(spark, root)
    keyed_table._publish(spark, root, before)
    assert ids_in(keyed_table.read_current(spark, root)) == ["a", "b"]


def test_a_changed_creation_time_moves_no_key(spark):
    """A key stays on the day of its first copy, whatever day later copies name."""
    root = fresh_dir(spark, "table")
    keyed_table.publish_snapshot(rows_of(spark, "k").union(rows_of(spark, "other", day=4)), root, 0)
    keyed_table.write_log_batch(rows_of(spark, "k", votes=9, day=1).union(rows_of(spark, "n", day=2)), root, 0)
    for _ in range(2):
        rows = {r.post_id: (r.upvotes, r.created_utc) for r in keyed_table.read_current(spark, root).collect()}
        assert rows == {"k": (9, DAYS[0]), "n": (1, DAYS[2]), "other": (1, DAYS[4])}
        assert ids_in(keyed_table.read_current(spark, root, since=DAYS[1].date())) == ["n", "other"]
        keyed_table.compact(spark, root)
    keyed_table.transfer(rows_of(spark, "n", votes=3, day=5).union(rows_of(spark, "k", votes=2, day=7)), root, 0)
    assert ids_in(keyed_table.read_snapshot(spark, root)) == ["k", "n", "other"]
    assert {r.post_id: r.upvotes for r in keyed_table.read_snapshot(spark, root).collect()} == {"k": 2, "n": 3, "other": 1}
    assert set(keyed_table.current_version(spark, root).days) == {"2024-01-01", "2024-01-03", "2024-01-05"}


def test_only_the_days_that_hold_the_keys_are_read(spark):
    root = fresh_dir(spark, "table")
    keyed_table.publish_snapshot(rows_of(spark, "a").union(rows_of(spark, "b", day=3)), root, 0)
    discard(spark, keyed_table.current_version(spark, root).days["2024-01-04"])
    keyed_table.transfer(rows_of(spark, "a", votes=5, day=3), root, 0)  # names the unreadable day
    assert view(keyed_table._read_days(spark, {"x": keyed_table.current_version(spark, root).days["2024-01-01"]}, POST_SCHEMA))["a"][0] == 5


def test_key_folders_are_folded(spark, monkeypatch):
    monkeypatch.setattr(keyed_table, "MAX_KEY_FOLDERS", 2)
    root = fresh_dir(spark, "table")
    for i in range(5):
        keyed_table.transfer(rows_of(spark, f"k{i}", "k0", votes=i, day=i), root, i)
    version = keyed_table.current_version(spark, root)
    assert len(version.keys) <= 2
    keys = {r.post_id: str(r._day) for r in keyed_table._read_keys(spark, version.keys, "post_id").collect()}
    assert keys == {f"k{i}": f"2024-01-0{i + 1}" for i in range(5)}
    assert view(keyed_table.read_snapshot(spark, root))["k0"][0] == 4
