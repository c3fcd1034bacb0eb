"""The given tables as posts. The SQL runs unchanged in Spark (`{events}` etc. are frames) and,
with the names put in, in any ANSI engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyvox.session import pin_utc

# Scores leave [-1, 1] on purpose; every 10th is null; `Norway` and `Rare Name` are rare.
POSTS_EVENTS = """
SELECT CAST(event_id AS string) AS post_id,
       concat('user_', CAST(user_id AS string)) AS author,
       CAST(ts AS timestamp) AS created_utc,
       event_type AS text,
       event_type AS subreddit,
       CAST(floor(value) AS int) AS upvotes,
       CAST(event_id % 50 AS int) AS num_comments,
       CASE WHEN event_id % 4 = 0 THEN NULL
            ELSE CAST(event_id - event_id % 4 AS string) END AS parent_post_id,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE round((value - 50.0) / 50.0, 4) END
         AS sentiment_score,
       CAST(NULL AS string) AS message_language,
       CASE WHEN event_id % 2000 = 1 THEN 'Norway'
            ELSE CASE event_id % 9 WHEN 0 THEN 'US' WHEN 1 THEN 'uk, US' WHEN 2 THEN ' Russia '
                 WHEN 3 THEN 'PRC,RF' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'japan'
                 WHEN 7 THEN 'EU,,UAE' ELSE 'north korea' END END AS country,
       CASE WHEN event_id % 500 = 1 THEN 'Rare Name'
            ELSE CASE event_id % 7 WHEN 0 THEN 'Biden' WHEN 1 THEN 'Joe Biden,Putin' WHEN 2 THEN 'Xi'
                 WHEN 3 THEN ' Macron ' WHEN 4 THEN '' WHEN 5 THEN NULL
                 ELSE 'Olaf Scholz,macron' END END AS leader,
       CAST(ts AS timestamp) AS last_processed
FROM {events}
"""

POSTS_DOCUMENTS = """
SELECT CAST(doc_id AS string) AS post_id,
       CASE doc_id % 8 WHEN 0 THEN 'AutoModerator' WHEN 1 THEN 'my_bot_x' WHEN 2 THEN 'robot'
            WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN '[deleted]' WHEN 6 THEN 'translator-BOT'
            ELSE concat('user', CAST(doc_id AS string)) END AS author,
       text,
       source AS subreddit,
       lang AS expected_language,
       CAST(n_chars AS int) AS upvotes
FROM {documents}
"""

POSTS_THREADS = """
SELECT concat(CAST(conv_id AS string), '-', CAST(turn AS string)) AS post_id,
       role AS author,
       text,
       CAST(turn AS int) AS turn,
       CASE WHEN turn = 0 THEN NULL ELSE concat(CAST(conv_id AS string), '-0') END AS parent_post_id
FROM {conversations}
"""


# Known schemas spare the job that reads file footers to infer them.
TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "lineitem": "l_orderkey bigint, l_linenumber int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _adapt(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf_dir, name)})


def posts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapt(spark, sf_dir, POSTS_EVENTS, "events")


def posts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapt(spark, sf_dir, POSTS_DOCUMENTS, "documents")


def posts_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapt(spark, sf_dir, POSTS_THREADS, "conversations")
