"""Automated-author filters, key dedupe and the target contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox import fixed_values as fixed
from tallyvox.operators.lookup import Dim
from tallyvox.schema import CONTRACT_LENGTHS, POST_KEY


def is_bot(author: Column, strict: bool = False) -> Column:
    """Null and empty authors count as automated; names and patterns ignore case."""
    names = fixed.KNOWN_BOTS_STRICT if strict else fixed.KNOWN_BOTS
    patterns = fixed.BOT_PATTERNS_STRICT if strict else fixed.BOT_PATTERNS
    return (
        (F.coalesce(author, F.lit("")) == "")
        | F.lower(author).isin(names)
        | author.rlike("(?idu)" + "|".join(patterns))
    )


def drop_bots(posts: DataFrame, strict: bool = False) -> DataFrame:
    return posts.where(~is_bot(F.col("author"), strict))


def drop_listed_authors(posts: DataFrame, names: Dim) -> DataFrame:
    """Anti-join with a table of lower-cased names (column `name`) of any size."""
    return posts.join(names.join_side(), F.lower("author") == F.col("name"), "left_anti")


def newest_first(posts: DataFrame) -> list[Column]:
    """Order of copies of a record: latest load, then most votes, then any fixed order."""
    rest = [c for c in posts.columns if c not in ("last_processed", "upvotes", POST_KEY)]
    return [
        F.col("last_processed").desc_nulls_last(),
        F.col("upvotes").desc_nulls_last(),
        F.xxhash64(*rest) if rest else F.lit(0),
    ]


def dedupe_posts(posts: DataFrame, key: str = POST_KEY) -> DataFrame:
    """One row per key. The rank filter also runs before the shuffle, so a key that holds a
    large share of the rows sends one row per map task."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*newest_first(posts)))
    return posts.withColumn("_copy", rank).where("_copy = 1").drop("_copy")


def contract_violations(
    posts: DataFrame, lengths: Mapping[str, int] = CONTRACT_LENGTHS, key: str = POST_KEY
) -> DataFrame:
    """Rows of (post_id, column_name, problem, amount): too long values, null and repeated keys."""
    checks = [
        F.when(
            F.length(name) > limit,
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit("too long").alias("problem"),
                F.length(name).cast("bigint").alias("amount"),
            ),
        )
        for name, limit in lengths.items()
        if name in posts.columns
    ]
    null_key = F.when(
        F.col(key).isNull(),
        F.struct(
            F.lit(key).alias("column_name"),
            F.lit("null key").alias("problem"),
            F.lit(1).cast("bigint").alias("amount"),
        ),
    )
    # The outer form: for the plain one, the optimizer adds a filter that repeats the checks.
    found = F.inline_outer(F.array_compact(F.array(*checks, null_key)))
    rows = posts.select(F.col(key), found).where(F.col("column_name").isNotNull())
    repeats = (
        posts.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("amount"))
        .where("amount > 1")
        .select(key, F.lit(key).alias("column_name"), F.lit("repeated key").alias("problem"), "amount")
    )
    return rows.unionByName(repeats)


def assert_contract(posts: DataFrame, **kwargs) -> DataFrame:
    """Raise when any row breaks the contract; stops at the first finding."""
    found = contract_violations(posts, **kwargs).first()
    if found is not None:
        raise ValueError(f"contract broken: {found.asDict()}")
    return posts


def bot_names(spark, names: Sequence[str] = tuple(fixed.KNOWN_BOTS_STRICT)) -> Dim:
    return Dim.inline(spark, [(name,) for name in names], ["name"])
