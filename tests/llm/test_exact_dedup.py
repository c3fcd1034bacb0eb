import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyvox.llm import exact_dedup


def brute(rows, keep):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    best = max if keep == "largest" else min
    return {t: (best(k for k in keys if k is not None), len(keys)) for t, keys in groups.items()}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_hot_text_is_salted_and_merged(spark, keep):
    """A text with a third of all rows, and one that is just hot, beside many single ones."""
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 7 == 0 else f"t{i // 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = exact_dedup.group_copies(docs, keep=keep).collect()
    wanted = brute(rows, keep)
    texts = dict(rows)
    assert len(found) == len(rows)
    for row in found:
        text = texts[row.doc_id]
        assert (row.keep_id, row.group_size) == wanted[text]
        assert row.kept == (row.doc_id == row.keep_id)
        assert row.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.without_copies(docs, keep=keep).collect()
    assert sorted(r.doc_id for r in kept) == sorted(k for k, _ in wanted.values())


@pytest.mark.parametrize("key", ["7", "NULL"])
def test_hot_rows_repeated_whole(spark, key):
    """A third of all rows share the text and the key, or have no key: one stays, and all are counted."""
    docs = spark.range(0, 3000, 1, 6).selectExpr(
        f"CASE WHEN id % 3 = 0 THEN {key} ELSE id END AS doc_id", "IF(id % 3 = 0, 'hot', 't' || id) AS text"
    )
    found = exact_dedup.group_copies(docs, keep="largest")
    hot = [r for r in found.collect() if r.group_size > 1]
    assert len(hot) == 1000 and {r.group_size for r in hot} == {1000} and sum(r.kept for r in hot) == 1
    assert {r.keep_id for r in hot} == {None if key == "NULL" else 7}
    assert exact_dedup.without_copies(docs, keep="largest").count() == 2001


def test_odd_rows(odd_documents):
    found = exact_dedup.group_copies(odd_documents, keep="largest").collect()
    assert len(found) == odd_documents.count()
    same = [r for r in found if r.keep_id == 20]
    assert len(same) == 5 and sum(r.kept for r in same) == 1 and {r.group_size for r in same} == {5}
    blank = {r.doc_id: r for r in found if r.doc_id in (0, 1)}
    assert blank[0].keep_id == 1 and not blank[0].kept and blank[1].kept
    smallest = exact_dedup.group_copies(odd_documents, keep="smallest").where("keep_id = 5").collect()
    assert sum(r.kept for r in smallest) == 1  # of repeated rows one stays


def test_columns_survive(odd_documents):
    kept = exact_dedup.without_copies(odd_documents, keep="largest")
    assert kept.schema == odd_documents.schema
    assert kept.count() == 8


def test_null_keys(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    found = exact_dedup.group_copies(docs).collect()
    assert sorted((r.keep_id, r.group_size, r.kept) for r in found if r.keep_id) == [(3, 2, False), (3, 2, True)]
    assert sorted(r.kept for r in found if r.keep_id is None) == [False, True]


def test_normalised(spark):
    docs = spark.createDataFrame([(1, " A"), (2, "a ")], "doc_id long, text string")
    found = exact_dedup.group_copies(docs, normalise=lambda t: F.lower(F.trim(t)))
    assert found.where("keep_id = 1 AND group_size = 2").count() == 2


def test_nothing(no_documents):
    assert exact_dedup.group_copies(no_documents).count() == 0
    assert exact_dedup.without_copies(no_documents).columns == no_documents.columns
