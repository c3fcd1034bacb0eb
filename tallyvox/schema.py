"""The post record, its target contract and the shapes of landed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST_SCHEMA = T.StructType(
    [
        T.StructField("post_id", T.StringType(), False),
        T.StructField("author", T.StringType()),
        T.StructField("created_utc", T.TimestampType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("upvotes", T.IntegerType()),
        T.StructField("num_comments", T.IntegerType()),
        T.StructField("parent_post_id", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("message_language", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("leader", T.StringType()),
        T.StructField("last_processed", T.TimestampType()),
    ]
)

POST_KEY = "post_id"
PARTITION_COLUMN = "created_date"  # the stored table has one folder per day
# Columns that a later copy of a record replaces; all others keep the first-seen value.
MUTABLE_COLUMNS = ("upvotes", "num_comments", "last_processed")

# Length limits of the target table.
CONTRACT_LENGTHS = {
    "post_id": 50,
    "author": 100,
    "subreddit": 50,
    "parent_post_id": 50,
    "message_language": 10,
    "country": 10,
    "leader": 100,
}

# `data` stays a map so that an absent field and a JSON null remain different.
_NODE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    ]
)
LISTING_SCHEMA = T.StructType(
    [T.StructField("data", T.StructType([T.StructField("children", T.ArrayType(_NODE))]))]
)
REPLY_SCHEMA = T.ArrayType(LISTING_SCHEMA)


def typed_posts(rows: DataFrame) -> DataFrame:
    """Give loosely typed rows the post schema; absent columns become null, bad values too."""

    def typed(field: T.StructField) -> Column:
        if field.name not in rows.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        # try_cast exists only between castable types, so plain casts stay for equal types.
        source = rows.schema[field.name].dataType
        column = F.col(field.name)
        return (column if source == field.dataType else column.try_cast(field.dataType)).alias(
            field.name
        )

    return rows.select(*[typed(f) for f in POST_SCHEMA.fields])


def typed_rejects(rows: DataFrame) -> DataFrame:
    """The rows that `with_post_schema` drops, as they came, with the reason."""
    typed = {f.name: f for f in POST_SCHEMA.fields}

    def missing(name: str) -> Column:
        kind = typed[name].dataType
        if name not in rows.columns:
            return F.lit(True)
        same = rows.schema[name].dataType == kind
        return (F.col(name) if same else F.col(name).try_cast(kind)).isNull()

    reason = F.when(missing("post_id"), "no id").when(missing("created_utc"), "no time")
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull())


def with_post_schema(posts: DataFrame) -> DataFrame:
    """`typed_posts`, without the rows that break the two NOT NULL columns (`typed_rejects`)."""
    return typed_posts(posts).where(
        F.col("post_id").isNotNull() & F.col("created_utc").isNotNull()
    )
