from datetime import datetime

import pytest

from tallyvox.operators import quality
from tallyvox.schema import POST_SCHEMA, typed_posts, with_post_schema


def test_bot_filter(spark):
    names = [None, "", "AutoModerator", "robot", "a_bot_b", "Automat", "BotKing", "xModeratorx",
             "transcriber9", "WikiTextBot", "[deleted]", "bob", "autumn", "abbot tale"]
    posts = spark.createDataFrame([(n,) for n in names], "author string")
    kept = [r.author for r in quality.drop_bots(posts).collect()]
    # "autumn" does not start with "auto"
    assert kept == ["transcriber9", "[deleted]", "bob", "autumn", "abbot tale"]
    strict = [r.author for r in quality.drop_bots(posts, strict=True).collect()]
    assert strict == ["[deleted]", "bob", "autumn", "abbot tale"]


def test_listed_authors(spark):
    posts = spark.createDataFrame([("TotesMessenger",), (None,), ("someone",)], "author string")
    kept = quality.drop_listed_authors(posts, quality.bot_names(spark)).collect()
    assert {r.author for r in kept} == {None, "someone"}


def post(key, **values):
    row = dict.fromkeys(POST_SCHEMA.fieldNames())
    row.update(post_id=key, created_utc=datetime(2024, 1, 1), **values)
    return row


def test_dedupe_order(spark):
    day = [datetime(2024, 1, d) for d in (1, 2)]
    rows = [
        post("a", upvotes=9, last_processed=day[0]),
        post("a", upvotes=1, last_processed=day[1]),
        post("a", upvotes=2, last_processed=day[1]),
        post("b", upvotes=None, last_processed=None),
        post("b", upvotes=3, last_processed=None),
    ]
    posts = spark.createDataFrame(rows, POST_SCHEMA)
    found = {r.post_id: r.upvotes for r in quality.dedupe_posts(posts).collect()}
    assert found == {"a": 2, "b": 3}


def test_contract(spark):
    rows = [post("a" * 51), post("b", country="x" * 11), post("b", country="ok")]
    posts = spark.createDataFrame(rows, POST_SCHEMA)
    found = {(r.post_id[:1], r.column_name, r.problem, r.amount) for r in quality.contract_violations(posts).collect()}
    assert found == {
        ("a", "post_id", "too long", 51),
        ("b", "country", "too long", 11),
        ("b", "post_id", "repeated key", 2),
    }
    with pytest.raises(ValueError):
        quality.assert_contract(posts)
    good = spark.createDataFrame([post("c")], POST_SCHEMA)
    assert quality.assert_contract(good) is good


def test_typed_posts(spark):
    raw = spark.createDataFrame(
        [("1", "2024-01-01 00:00:00", "7", "x"), ("2", "never", "8", "y"), ("3", "2024-01-02", "bad", "z")],
        "post_id string, created_utc string, upvotes string, extra string",
    )
    assert typed_posts(raw).columns == POST_SCHEMA.fieldNames()
    assert [f.dataType for f in typed_posts(raw).schema] == [f.dataType for f in POST_SCHEMA]
    found = {r.post_id: r.upvotes for r in with_post_schema(raw).collect()}
    assert found == {"1": 7, "3": None}
