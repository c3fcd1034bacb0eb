"""The plans are the ones intended: no Python workers, pruned scans, limits before shuffles."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tallyvox.operators import merge, ranking
from tallyvox.plans.adapters import posts_events
from tallyvox.plans.queries import QUERIES


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


CHEAP = sorted(set(QUERIES) - {"sink_ignore", "sink_append", "transfer_batch", "sink_atomic_snapshot"})


@pytest.mark.parametrize("name", CHEAP)
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    for bad in ("EvalPython", "PythonUDF", "InPandas", "InArrow", "CartesianProduct", "NestedLoop"):
        assert bad not in text


@pytest.mark.parametrize(
    "name", ["enrich_posts", "enrich_struct", "detect_country", "detect_all_entities", "lexicon_sentiment_rules",
             "detect_language", "bot_filter", "clean_text"]
)
def test_row_wise_queries_move_no_text_for_their_work(spark, sf_dir, name):
    assert "Exchange" not in plan(queries()[name](spark, sf_dir))


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    text = plan(QUERIES["scan_posts"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in text
    text = plan(QUERIES["bot_filter"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_group_limit_runs_before_the_shuffle(spark, sf_dir):
    for name in ("latest_per_source", "comments_per_post_k", "dedupe_posts", "lang_profile_train"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "WindowGroupLimit" in text and "Partial" in text, name


def test_top_k_keeps_k_rows(spark, sf_dir):
    for name in ("top_positive", "top_negative", "top_upvoted", "top3_leaders"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


def test_small_upsert_leaves_the_base_in_place(spark, sf_dir):
    posts = posts_events(spark, sf_dir)
    updates = posts.where("upvotes > 300")
    merged = merge.upsert(posts, updates)
    text = plan(merged)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    large = plan(merge.upsert(posts, updates, broadcast_updates=False))
    assert "FullOuter" in large


def test_group_limit_keeps_hot_groups_small(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    top = ranking.top_k_per_group(rows, ["k"], [F.col("id").desc()], 2)
    assert top.where("k = 0").count() == 2
    assert top.count() == 2 + 100_000 - 33_334
