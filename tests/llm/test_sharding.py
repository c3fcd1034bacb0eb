import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyvox.llm import sharding
from tallyvox.llm.queries import LLM_QUERIES
from tallyvox.session import fresh_dir


def write(spark, docs, **options):
    return sharding.write_shards(docs, fresh_dir(spark, "shards"), **options)


def test_query_keeps_its_law(spark, sf_dir, documents):
    rows = LLM_QUERIES["op4_sharding"](spark, sf_dir).collect()
    texts = dict(documents)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 16, zlib.crc32(body), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0 < sum(r.grown_shard == 40 for r in rows) < len(rows) / 8


def test_growing_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(20_000)
    columns = [sharding.shard_of(F.col("id"), n, 5).alias(f"s{n}") for n in range(1, 12)]
    rows = ids.select(*columns).collect()
    for n in range(1, 11):
        moved = [r[n] for r in rows if r[n] != r[n - 1]]
        assert set(moved) <= {n} and 0.7 < len(moved) * (n + 1) / len(rows) < 1.3
    assert max(Counter(r[10] for r in rows).values()) < 1.15 * len(rows) / 11


def test_many_buckets_shuffle_within_a_shard(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    found = write(spark, docs, shards=2, bucket_bytes=40_000, seed=1)
    assert found.select("bucket").distinct().count() > 8
    for shard in (0, 1):
        order = [r.doc_id for r in found.where(f"shard = {shard}").orderBy("slot").collect()]
        rising = sum(a < b for a, b in zip(order, order[1:])) / len(order)
        assert 0.4 < rising < 0.6
    again = write(spark, docs, shards=2, bucket_bytes=40_000, seed=1)
    assert sorted(found.collect()) == sorted(again.collect())
    other = write(spark, docs, shards=2, bucket_bytes=40_000, seed=2)
    assert sorted(found.collect()) != sorted(other.collect())


def test_rows_of_a_bucket_stand_in_any_order(spark):
    """Each of the six orders of three rows comes up about as often."""
    orders = Counter()
    docs = spark.range(3).selectExpr("id AS doc_id", "'t' AS text").coalesce(1)
    for seed in range(60):
        kept = write(spark, docs, shards=1, seed=seed).orderBy("slot").collect()
        orders[tuple(r.doc_id for r in kept)] += 1
    assert len(orders) == 6


def test_odd_rows(spark, odd_documents, no_documents):
    found = write(spark, odd_documents, shards=3)
    assert found.count() == odd_documents.count()
    assert {"shard_in", "slot_in", "row", "bits"} <= set(found.columns)
    assert found.agg(F.sum("shard_in")).first() == odd_documents.agg(F.sum("shard")).first()
    for shard in found.select("shard").distinct().collect():
        slots = sorted(r.slot for r in found.where(F.col("shard") == shard.shard).collect())
        assert slots == list(range(len(slots)))
    hot = spark.createDataFrame([(1, f"text {i % 40}") for i in range(2000)], "doc_id long, text string")
    spread = write(spark, hot, shards=2, bucket_bytes=2000)
    assert spread.select("shard").distinct().count() == 1 and spread.select("bucket").distinct().count() > 5
    assert write(spark, no_documents, shards=3).count() == 0


def test_a_shard_has_the_buckets_its_bytes_ask_for(spark):
    """One key holds a third of all rows: its shard has more buckets, none of them larger."""
    docs = spark.range(6000).selectExpr("IF(id % 3 = 0, -1, id) AS doc_id", "'text ' || id || repeat('x', 90) AS text")
    found = write(spark, docs, shards=6, bucket_bytes=20_000)
    sizes = found.groupBy("shard", "bucket").agg(F.sum(F.length("text") + 16).alias("bytes")).collect()
    assert max(r.bytes for r in sizes) < 2 * 20_000 and found.count() == 6000
    counts = Counter(r.shard for r in sizes)
    hot = found.where("doc_id = -1").first().shard
    assert counts[hot] > 2 * max(n for shard, n in counts.items() if shard != hot)
    assert len({r.bucket for r in sizes}) == len(sizes)
