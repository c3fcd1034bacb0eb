"""The registered corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm import (
    edit_embedding,
    exact_dedup,
    packing,
    phrases,
    rtree,
    sentencepiece_backend,
    sharding,
    simhash,
    tokens,
    toxicity,
    url_filter,
    voronoi,
    warc,
)
from tallyvox.llm.common import read, tokenizer_path
from tallyvox.session import fresh_dir
from tallyvox.llm.sql import LLM_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    LLM_QUERIES[build.__name__] = build
    return build


@query
def op1_toxicity(spark, sf_dir):
    """The toxicity score of every document."""
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


@query
def op2_url_filter(spark, sf_dir):
    """The verdict of the four rules on every page's URL."""
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


@query
def op3_token_counts(spark, sf_dir):
    """Bytes and tokens of every document."""
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op4_sharding(spark, sf_dir):
    """All documents, shuffled and written as 40 shards by the law `key`."""
    docs = read(spark, sf_dir, "documents")
    shards = sharding.write_shards(docs, fresh_dir(spark, "shards"), shards=40, seed=7)
    return shards.select(
        "doc_id",
        sharding.row_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("doc_id"), 41, 7).alias("grown_shard"),
    )


@query
def op5_exact_dedup(spark, sf_dir):
    """Copies of each document; the one with the largest doc_id stays."""
    return exact_dedup.group_copies(read(spark, sf_dir, "documents"), keep="largest")


@query
def op6_packing(spark, sf_dir):
    """The documents packed into sequences of at most 2048 tokens."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op7_simhash(spark, sf_dir):
    """The near-duplicate component of each document by its 64-bit SimHash."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op8_edit_embedding(spark, sf_dir):
    """Fingerprints of each document and of its edited text, and how alike they are."""
    return edit_embedding.compare_successors(read(spark, sf_dir, "documents"))


@query
def op9_sentencepiece(spark, sf_dir):
    """The pieces of every document; whether they are those of the sentencepiece library, and
    whether they give the text again."""
    path = tokenizer_path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_backend.encode(docs, path, decoded=True)
    return coded.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        "parity",
        (F.col("decoded") == F.coalesce(F.col("row.text"), F.lit(""))).alias("round_trip"),
    )


@query
def op10_warc(spark, sf_dir):
    """The pages as WARC records in ZIP packages, read back by range."""
    records = warc.round_trip(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_voronoi_knn(spark, sf_dir):
    """The five best other vectors of every fiftieth vector, by integer inner product."""
    return voronoi.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op12_collocations(spark, sf_dir):
    """The 2,000 best phrases of two or three words of each language."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector; every seventh vector carries the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)
