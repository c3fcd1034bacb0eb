import json
from datetime import datetime

from tallyvox.operators.threads import newer_than
from tallyvox.schema import POST_SCHEMA, typed_rejects, with_post_schema
from tallyvox.sources import landed
from tallyvox.sources.posts import append_posts, create_if_absent, load_posts, scan_posts
from tallyvox.session import fresh_dir
from tests.test_quality import post

PAGE = {
    "kind": "Listing",
    "data": {
        "after": None,
        "children": [
            {"kind": "t3", "data": {"id": "a", "author": "x", "created_utc": 1704067200.0, "selftext": "body",
                                    "title": "t", "score": 5, "num_comments": 2, "extra": {"deep": [1]}}},
            {"kind": "t3", "data": {"id": "b", "created_utc": 1704067201, "selftext": "", "title": "t"}},
            {"kind": "t3", "data": {"id": "c", "author": None, "created_utc": 1704067202.25, "selftext": " "}},
            {"kind": "t3", "data": {"author": "no id", "created_utc": 1704067202.0}},
        ],
    },
}
REPLY = [
    {"data": {"children": [{"kind": "t3", "data": {"id": "a"}}]}},
    {
        "data": {
            "children": [
                {"kind": "t1", "data": {"id": "k1", "created_utc": 1704067300.0, "body": "hi", "author": "y",
                                        "subreddit": "s", "score": -3}},
                {"kind": "more", "data": {"id": "k2"}},
                {"kind": "t1", "data": {"id": "k3", "created_utc": 1704067301.0}},
            ]
        }
    },
]


def test_listing_text(spark):
    pages = spark.createDataFrame([(json.dumps(PAGE), "news")], "listing string, subreddit string")
    found = landed.parse_listing(pages).orderBy("post_id").collect()
    view = [(r.post_id, r.author, r.text, r.upvotes, r.num_comments, r.subreddit, r.parent_post_id) for r in found]
    assert view == [
        ("a", "x", "body", 5, 2, "news", None),
        ("b", "[deleted]", "t", 0, 0, "news", None),
        ("c", None, " ", 0, 0, "news", None),
    ]
    assert found[2].created_utc == datetime(2024, 1, 1, 0, 0, 2, 250000)


def test_listing_files(spark, tmp_path):
    for source in ("news", "world"):
        folder = tmp_path / f"subreddit={source}"
        folder.mkdir()
        (folder / "p.json").write_text(json.dumps(PAGE) + "\n")
        (folder / "empty.json").write_text("")
    found = landed.read_listings(spark, str(tmp_path))
    assert found.columns == POST_SCHEMA.fieldNames()
    assert {(r.subreddit, r.post_id) for r in found.collect()} == {
        (s, p) for s in ("news", "world") for p in "abc"
    }


def test_replies(spark, tmp_path):
    folder = tmp_path / "post_id=a"
    folder.mkdir()
    (folder / "r.json").write_text(json.dumps(REPLY) + "\n" + json.dumps(REPLY[:1]) + "\nnot json\n")
    found = landed.read_replies(spark, str(tmp_path)).orderBy("post_id").collect()
    view = [(r.post_id, r.author, r.text, r.upvotes, r.num_comments, r.subreddit, r.parent_post_id) for r in found]
    assert view == [("k1", "y", "hi", -3, 0, "s", "a"), ("k3", "[deleted]", "", 0, 0, "", "a")]


def test_post_table(spark):
    path = fresh_dir(spark, "posts")
    create_if_absent(spark, path)
    assert scan_posts(spark, path).isEmpty()
    row = post("a", sentiment_score=-4.0, upvotes=1)
    other = post("b", upvotes=2)
    append_posts(spark.createDataFrame([row], POST_SCHEMA), path)
    append_posts(spark.createDataFrame([other], POST_SCHEMA), path)
    create_if_absent(spark, path)
    assert {r.post_id for r in scan_posts(spark, path, "post_id").collect()} == {"a", "b"}
    loaded = load_posts(scan_posts(spark, path)).collect()
    assert [(r.post_id, r.sentiment_score, r.hour_of_day, r.day_of_week) for r in loaded] == [("a", -1.0, 0, 1)]


def test_newer_than_skips_day_folders(spark):
    path = fresh_dir(spark, "posts")
    rows = [dict(post(str(d), upvotes=1), created_utc=datetime(2024, 1, d, 12)) for d in range(1, 5)]
    append_posts(spark.createDataFrame(rows, POST_SCHEMA), path)
    newer = newer_than(scan_posts(spark, path), datetime(2024, 1, 3, 11))
    assert {r.post_id for r in newer.collect()} == {"3", "4"}
    scan = newer._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in scan


def test_rejects_are_what_parsing_leaves_out(spark):
    good = '{"kind":"t3","data":{"id":"a","created_utc":5}}'
    bad = ['{"kind":"t3","data":{"id":null,"created_utc":5}}', '{"kind":"t3","data":{"id":"b","created_utc":"x"}}']
    pages = [f'{{"data":{{"children":[{",".join([good, *bad])}]}}}}', '{"data":{"children":[' + good, "no json", None]
    frame = spark.createDataFrame([(p, "s") for p in pages], "listing string, subreddit string")
    found = landed.listing_rejects(frame).collect()
    reasons = sorted(r.reason for r in found)
    assert reasons == ["no id", "no time", "unreadable", "unreadable", "unreadable"]
    assert {r.content for r in found if r.reason == "unreadable"} == set(pages[1:])
    assert [r.post_id for r in landed.parse_listing(frame).collect()] == ["a"]
    comment = '{"kind":"t1","data":{"id":"c","created_utc":5}}'
    more = '{"kind":"more","data":{"id":null}}'
    lost = '{"kind":"t1","data":{"created_utc":5}}'
    empty = '{"data":{"children":[]}}'
    replies = [f'[{empty},{{"data":{{"children":[{comment},{more},{lost}]}}}}]', f"[{empty}]", "[broken"]
    frame = spark.createDataFrame([(r, "p") for r in replies], "reply string, post_id string")
    assert sorted(r.reason for r in landed.reply_rejects(frame).collect()) == ["no id", "unreadable"]


def test_typed_rejects(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "soon", 2), (None, "2024-01-01", 3)], "post_id string, created_utc string, x int")
    found = {(r.x, r.reason) for r in typed_rejects(rows).collect()}
    assert found == {(2, "no time"), (3, "no id")}
    assert with_post_schema(rows).count() == 1


def test_a_null_title_stays_null(spark):
    nodes = '{"kind":"t3","data":{"id":"a","created_utc":5,"title":null}},{"kind":"t3","data":{"id":"b","created_utc":5}}'
    frame = spark.createDataFrame([(f'{{"data":{{"children":[{nodes}]}}}}', "s")], "listing string, subreddit string")
    assert {r.post_id: r.text for r in landed.parse_listing(frame).collect()} == {"a": None, "b": ""}
