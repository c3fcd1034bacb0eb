"""The corpus pipeline: toxicity, exact copies, near copies, packing.

Each stage takes all rows its predecessor kept and returns the columns of `documents`; the last
returns the packed pieces. Stages are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm import exact_dedup, packing, simhash, toxicity
from tallyvox.llm.common import read, stored, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is fitted on the labelled documents
    outside the held-out fold."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.without_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash fingerprints (three-word shingles, at most three differing bits),
    the document with the smallest doc_id."""
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in sequences of at most 2048 tokens: one row per piece."""
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]

# No stage but the second can be said in SQL; the tests hold the others to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL: dict[str, str] = {}
