"""Lookup files: gazetteers (JSON), lexicons (tab-separated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAZETTEER_SCHEMA = "name string, code string, alternatives array<string>"


def flatten_gazetteer(entries: DataFrame, value: Column, order: Column) -> DataFrame:
    """(alias, value): names and alternatives in lower case. An alias that occurs twice keeps
    the value of its last entry."""
    alternatives = F.coalesce("alternatives", F.array().cast("array<string>"))
    aliases = entries.select(
        value.alias("value"),
        order.alias("_entry"),
        F.posexplode_outer(F.concat(F.array("name"), alternatives)).alias("_pos", "_alias"),
    )
    return aliases.groupBy(F.lower("_alias").alias("alias")).agg(
        F.max_by("value", F.struct("_entry", "_pos")).alias("value")
    )


def read_gazetteer(spark: SparkSession, path: str, value: str = "code") -> DataFrame:
    """A JSON array of {name, code, alternatives}; `value` is the column an alias stands for."""
    entries = spark.read.schema(GAZETTEER_SCHEMA).option("multiLine", True).json(path)
    return flatten_gazetteer(entries, F.col(value), F.monotonically_increasing_id())


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(token, valence) from lines of token, tab, mean rating and optional further fields."""
    fields = F.split("value", "\t")
    return (
        spark.read.text(path)
        .select(
            F.lower(fields[0]).alias("token"),
            F.get(fields, F.lit(1)).try_cast("double").alias("valence"),
        )
        .where((F.col("token") != "") & F.col("valence").isNotNull())
    )
