"""Landed JSON replies of a forum API to post rows.

Fields are read through a map: a missing field takes its default, a JSON null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvox.functions.text import body_or_title
from tallyvox.functions.times import epoch_to_ts
from tallyvox.schema import LISTING_SCHEMA, POST_SCHEMA, REPLY_SCHEMA

DELETED_AUTHOR = "[deleted]"
COMMENT_KIND = "t1"
POST_ID_PREFIX = "t3_"


def _field(data: Column, name: str, default: str | None) -> Column:
    return F.when(F.map_contains_key(data, name), data[name]).otherwise(F.lit(default))


def _whole(value: Column) -> Column:
    return value.try_cast("double").try_cast("int")


def _post_columns(values: dict[str, Column]) -> list[Column]:
    return [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in POST_SCHEMA.fields
    ]


def parse_listing(
    pages: DataFrame, listing: Column | str = "listing", source: Column | str = "subreddit"
) -> DataFrame:
    """Post rows from listing pages; `listing` is JSON text or already of LISTING_SCHEMA.

    Nodes without an id or a creation time cannot be keyed and are left out; `listing_rejects`
    returns them, and the pages that cannot be read.
    """
    listing = F.col(listing) if isinstance(listing, str) else listing
    source = F.col(source) if isinstance(source, str) else source
    if isinstance(pages.select(listing).schema[0].dataType, T.StringType):
        listing = F.from_json(listing, LISTING_SCHEMA)
    # The outer form: for the plain one, the optimizer adds a filter that parses the text again.
    node = F.explode_outer(listing["data"]["children"]).alias("_n")
    nodes = pages.select(source.alias("_source"), node)
    data = F.col("_n")["data"]
    return nodes.select(
        *_post_columns(
            {
                "post_id": data["id"],
                "author": _field(data, "author", DELETED_AUTHOR),
                "created_utc": epoch_to_ts(data["created_utc"].try_cast("double")),
                "text": body_or_title(data["selftext"], _field(data, "title", "")),
                "subreddit": F.col("_source"),
                "upvotes": _whole(_field(data, "score", "0")),
                "num_comments": _whole(_field(data, "num_comments", "0")),
            }
        )
    ).where(F.col("post_id").isNotNull() & F.col("created_utc").isNotNull())


def _rejects(pages: DataFrame, raw: Column, source: Column, parsed: Column, kind: str | None) -> DataFrame:
    node = F.explode_outer(parsed["data"]["children"]).alias("_n")
    rows = pages.select(source.alias("source"), raw.alias("_raw"), parsed["data"]["children"].isNull().alias("_broken"), node)
    data = F.col("_n")["data"]
    mine = F.col("_n")["kind"] == kind if kind else F.col("_n").isNotNull()
    reason = (
        F.when(F.col("_broken"), "unreadable")
        .when(mine & data["id"].isNull(), "no id")
        .when(mine & epoch_to_ts(data["created_utc"].try_cast("double")).isNull(), "no time")
    )
    content = F.when(F.col("_broken"), F.col("_raw")).otherwise(F.to_json(data))
    return rows.select("source", reason.alias("reason"), content.alias("content")).where("reason IS NOT NULL")


def listing_rejects(pages: DataFrame, listing: str = "listing", source: str = "subreddit") -> DataFrame:
    """What `parse_listing` leaves out of JSON text: (source, reason, content). `unreadable` pages
    (broken JSON, or no list of nodes) come whole, nodes with `no id` or `no time` one by one."""
    return _rejects(pages, F.col(listing), F.col(source), F.from_json(listing, LISTING_SCHEMA), None)


def reply_rejects(replies: DataFrame, reply: str = "reply", post_id: str = "post_id") -> DataFrame:
    """What `parse_comments` leaves out of JSON text, other than nodes that are no comments and
    replies without a second part."""
    whole = F.from_json(reply, REPLY_SCHEMA)
    none = F.from_json(F.lit('{"data":{"children":[]}}'), LISTING_SCHEMA)
    second = F.when(F.size(whole) > 1, F.get(whole, F.lit(1))).when(whole.isNotNull(), none)
    return _rejects(replies, F.col(reply), F.col(post_id), second, COMMENT_KIND)


def parse_comments(
    replies: DataFrame, reply: Column | str = "reply", post_id: Column | str = "post_id"
) -> DataFrame:
    """Comment rows from replies [post listing, comment listing]; other node kinds are left out."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    post_id = F.col(post_id) if isinstance(post_id, str) else post_id
    if isinstance(replies.select(reply).schema[0].dataType, T.StringType):
        reply = F.from_json(reply, REPLY_SCHEMA)
    second = F.get(reply, F.lit(1))
    node = F.explode_outer(second["data"]["children"]).alias("_n")
    nodes = replies.select(post_id.alias("_parent"), node).where(F.col("_n")["kind"] == COMMENT_KIND)
    data = F.col("_n")["data"]
    return nodes.select(
        *_post_columns(
            {
                "post_id": data["id"],
                "author": _field(data, "author", DELETED_AUTHOR),
                "created_utc": epoch_to_ts(data["created_utc"].try_cast("double")),
                "text": _field(data, "body", ""),
                "subreddit": _field(data, "subreddit", ""),
                "upvotes": _whole(_field(data, "score", "0")),
                "num_comments": F.lit(0),
                "parent_post_id": F.col("_parent"),
            }
        )
    ).where(F.col("post_id").isNotNull() & F.col("created_utc").isNotNull())


def read_listings(
    spark: SparkSession, path: str, stream: bool = False, **options: str
) -> DataFrame:
    """Post rows from files below `path/subreddit=<source>/`, one listing page per line
    (or per file with multiLine="true")."""
    schema = T.StructType([*LISTING_SCHEMA.fields, T.StructField("subreddit", T.StringType())])
    reader = (spark.readStream if stream else spark.read).schema(schema).options(**options)
    return parse_listing(reader.json(path), F.struct("data"))


def read_replies(
    spark: SparkSession, path: str, stream: bool = False, **options: str
) -> DataFrame:
    """Comment rows from files below `path/post_id=<id>/`, one reply per line."""
    schema = "value string, post_id string"
    reader = (spark.readStream if stream else spark.read).schema(schema).options(**options)
    return parse_comments(reader.text(path), "value", "post_id")


def cursor_token(post_id: Column) -> Column:
    """The token under which the API names a post as a page start."""
    return F.concat(F.lit(POST_ID_PREFIX), post_id)
