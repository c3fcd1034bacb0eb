"""The registered batch queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.fixed_values import COUNTRY_GAZETTEER, LEADER_ALIASES, LEADER_GAZETTEER, LEXICON
from tallyvox.functions import scores, text, times
from tallyvox.operators import entities, language, merge, quality, ranking, sentiment, sketches, threads
from tallyvox.operators.enrich import analysis_struct, enrich
from tallyvox.operators.lookup import Dim
from tallyvox.plans import models, reports
from tallyvox.plans.adapters import (
    TABLE_SCHEMAS,
    posts_documents,
    posts_events,
    posts_threads,
    table,
)
from tallyvox.schema import typed_rejects, with_post_schema
from tallyvox.session import fresh_dir
from tallyvox.sources import keyed_table, landed, lookups, posts as post_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PAGE_SIZE = 100


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def six(value: str) -> Column:
    return F.round(value, 6).alias(value)


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post_table.load_posts(posts_events(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as posts, for queries whose cost is the work on the text."""
    return posts_documents(spark, sf_dir)


# --- sources and sinks ---------------------------------------------------------------------


@query
def parse_listing(spark, sf_dir):
    """Events as listing pages of at most 100 posts, with absent, null and empty fields."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    node = F.to_json(
        F.struct(
            n.cast("string").alias("id"),
            F.when((n % 11 != 0) & (n % 7 != 0), F.concat(F.lit("user_"), "user_id")).alias("author"),
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("created_utc"),
            F.when(n % 3 == 0, "").when(n % 3 == 2, F.col("event_type")).alias("selftext"),
            F.when(n % 5 != 0, F.concat(F.lit("title "), "event_type")).alias("title"),
            F.when(n % 13 != 0, F.floor("value").cast("int")).alias("score"),
            (n % 50).alias("num_comments"),
        )
    )
    null_author = F.concat(F.lit('{"author":null,'), F.substring(node, 2, 1 << 30))
    node = F.concat(
        F.lit('{"kind":"t3","data":'), F.when(n % 11 == 0, null_author).otherwise(node), F.lit("}")
    )
    pages = (
        e.select(F.col("event_type").alias("subreddit"), F.floor(n / PAGE_SIZE).alias("page"), node.alias("node"))
        .groupBy("subreddit", "page")
        .agg(F.array_join(F.collect_list("node"), ",").alias("nodes"))
        .select(
            "subreddit",
            F.concat(F.lit('{"data":{"children":['), "nodes", F.lit("]}}")).alias("listing"),
        )
    )
    parsed = landed.parse_listing(pages)
    return parsed.select(
        "post_id", "author", stamp(F.col("created_utc")).alias("created_utc"), "text",
        "subreddit", "upvotes", "num_comments", "parent_post_id",
    )


@query
def parse_comments(spark, sf_dir):
    """Conversation turns as replies of at most 100 comments; some replies have no second part."""
    c = table(spark, sf_dir, "conversations").where("turn > 0")
    turn, conv = F.col("turn"), F.col("conv_id")
    data = F.to_json(
        F.struct(
            F.concat_ws("-", conv, turn).alias("id"),
            F.when(turn % 3 != 0, F.col("role")).alias("author"),
            (conv * 100 + turn + 1_700_000_000).cast("double").alias("created_utc"),
            F.when(turn % 7 != 6, F.col("text")).alias("body"),
            F.when(turn % 2 == 0, F.lit("talk")).alias("subreddit"),
            turn.alias("score"),
        )
    )
    node = F.concat(
        F.lit('{"kind":"'), F.when(turn % 5 == 4, "more").otherwise("t1"), F.lit('","data":'), data, F.lit("}")
    )
    first = F.concat(
        F.lit('[{"data":{"children":[{"kind":"t3","data":{"id":"'), conv, F.lit('-0"}}]}}')
    )
    replies = (
        c.select(conv, F.floor(turn / PAGE_SIZE).alias("page"), node.alias("node"))
        .groupBy("conv_id", "page")
        .agg(F.array_join(F.collect_list("node"), ",").alias("nodes"))
        .select(
            F.concat(F.col("conv_id"), F.lit("-0")).alias("post_id"),
            F.when(F.col("conv_id") % 10 == 9, F.concat(first, F.lit("]")))
            .otherwise(
                F.concat(first, F.lit(',{"data":{"children":['), F.col("nodes"), F.lit("]}}]"))
            )
            .alias("reply"),
        )
    )
    parsed = landed.parse_comments(replies)
    return parsed.select(
        "post_id", "author", stamp(F.col("created_utc")).alias("created_utc"), "text",
        "subreddit", "upvotes", "num_comments", "parent_post_id",
    )


@query
def rejected_rows(spark, sf_dir):
    """Broken pages, nodes without an id or a time, and typed rows without them, counted."""
    e = table(spark, sf_dir, "events")
    n, page = F.col("event_id"), F.floor(F.col("event_id") / PAGE_SIZE)
    data = F.to_json(
        F.struct(
            F.when(n % 19 != 0, n.cast("string")).alias("id"),
            F.when(n % 23 != 0, n.cast("string")).otherwise(F.lit("soon")).alias("created_utc"),
        )
    )
    node = F.concat(F.lit('{"kind":"t3","data":'), data, F.lit("}"))
    pages = (
        e.select(F.col("event_type").alias("subreddit"), page.alias("page"), node.alias("node"))
        .groupBy("subreddit", "page")
        .agg(F.array_join(F.collect_list("node"), ",").alias("nodes"))
        .select(
            "subreddit",
            F.concat(
                F.lit('{"data":{"children":['), "nodes", F.when(F.col("page") % 7 == 3, "").otherwise("]}}")
            ).alias("listing"),
        )
    )
    rows = e.select(
        F.when(n % 29 != 0, n.cast("string")).alias("post_id"),
        F.when(n % 31 != 0, F.col("ts").cast("string")).otherwise(F.lit("soon")).alias("created_utc"),
        F.col("event_type").alias("source"),
    )
    landed_rows = landed.listing_rejects(pages).select("source", "reason", F.lit("listing").alias("input"))
    typed_rows = typed_rejects(rows).select("source", "reason", F.lit("rows").alias("input"))
    return landed_rows.union(typed_rows).groupBy("input", "source", "reason").agg(
        F.count(F.lit(1)).alias("rejected")
    )


@query
def typed_posts(spark, sf_dir):
    """Rows of text fields to the post schema; bad numbers become null, bad times drop the row."""
    n = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        n.cast("string").alias("post_id"),
        F.when(n % 19 == 0, "soon").otherwise(F.col("ts").cast("string")).alias("created_utc"),
        F.col("event_type").alias("subreddit"),
        F.when(n % 17 == 0, "n/a").otherwise(F.floor("value").cast("string")).alias("upvotes"),
        F.col("value").cast("string").alias("sentiment_score"),
    )
    return with_post_schema(raw).select(
        "post_id", stamp(F.col("created_utc")).alias("created_utc"), "subreddit", "upvotes",
        "num_comments", "sentiment_score", "leader",
    )


@query
def scan_posts(spark, sf_dir):
    frame = post_table.scan_posts(
        spark, f"{sf_dir}/events.parquet", "event_id", "event_type", "value", schema=TABLE_SCHEMAS["events"]
    )
    return frame


@query
def load_posts(spark, sf_dir):
    return loaded(spark, sf_dir).select(
        "post_id", "text", "sentiment_score", "country", "leader", "upvotes",
        stamp(F.col("created_utc")).alias("created_utc"), "hour_of_day", "day_of_week", "date",
    )


@query
def sink_ignore(spark, sf_dir):
    """Creating the table twice leaves what was appended in between."""
    path = fresh_dir(spark, "posts")
    post_table.create_if_absent(spark, path)
    post_table.append_posts(posts_events(spark, sf_dir), path)
    post_table.create_if_absent(spark, path)
    return post_table.scan_posts(spark, path, "subreddit").groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("posts")
    )


@query
def sink_append(spark, sf_dir):
    path = fresh_dir(spark, "posts")
    posts = posts_events(spark, sf_dir)
    post_table.append_posts(posts.where(F.col("created_utc") <= F.lit(models.MARK)), path)
    post_table.append_posts(posts.where(F.col("created_utc") > F.lit(models.MARK)), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("created_date").agg(
        F.count(F.lit(1)).alias("posts"), F.sum(F.col("upvotes").cast("bigint")).alias("upvotes")
    )


@query
def gazetteer_flatten(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("code"),
        F.array(F.col("p_type"), F.concat_ws(" ", "p_name", "p_type")).alias("alternatives"),
    )
    return lookups.flatten_gazetteer(entries, F.col("code"), F.col("p_partkey"))


def _upsert_pair(spark, sf_dir):
    posts = posts_events(spark, sf_dir)
    number = F.col("post_id").cast("bigint")
    base = posts.where(number % 3 != 0)

    def copies(rows, votes, days):
        return rows.withColumns(
            {
                "upvotes": F.col("upvotes") + votes,
                "text": F.lit("changed"),
                "last_processed": F.col("last_processed") + F.make_interval(days=F.lit(days)),
            }
        )

    updates = copies(posts.where((number % 2 == 0) | (number % 3 == 0)), 1, 1)
    repeated = copies(posts.where(number % 10 == 0), 5, 2)
    return base, updates.unionByName(repeated)


def _merged_view(merged: DataFrame) -> DataFrame:
    return merged.select(
        "post_id", "text", "upvotes", "num_comments", "country",
        stamp(F.col("last_processed")).alias("last_processed"),
    )


@query
def upsert_posts(spark, sf_dir):
    base, updates = _upsert_pair(spark, sf_dir)
    return _merged_view(merge.upsert(base, updates))


@query
def transfer_batch(spark, sf_dir):
    """Staged files into the published table: scan, merge, write, publish."""
    base, updates = _upsert_pair(spark, sf_dir)
    root, staged = fresh_dir(spark, "table"), fresh_dir(spark, "staged")
    keyed_table.publish_snapshot(base, root, 0)
    post_table.append_posts(updates, staged)
    batch = post_table.scan_posts(spark, staged)
    keyed_table.transfer(batch, root, 0)
    keyed_table.transfer(batch, root, 0)  # a repeated transfer changes nothing
    return _merged_view(keyed_table.read_snapshot(spark, root))


@query
def sink_atomic_snapshot(spark, sf_dir):
    """Publishing a version again, or an older one, changes nothing."""
    root = fresh_dir(spark, "table")
    base, updates = _upsert_pair(spark, sf_dir)
    keyed_table.publish_snapshot(base, root, 1)
    keyed_table.publish_snapshot(merge.upsert(base, updates), root, 2)
    keyed_table.publish_snapshot(base, root, 2)
    keyed_table.publish_snapshot(base, root, 1)
    stored = keyed_table.read_snapshot(spark, root)
    return stored.groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("posts"), F.sum(F.col("upvotes").cast("bigint")).alias("upvotes")
    )


@query
def schema_violations(spark, sf_dir):
    posts = posts_events(spark, sf_dir)
    again = posts.where(F.col("num_comments") == 7)
    return quality.contract_violations(posts.unionByName(again))


# --- filters and projections ---------------------------------------------------------------


@query
def bot_filter(spark, sf_dir):
    return quality.drop_bots(posts_documents(spark, sf_dir)).select("post_id", "author")


@query
def bot_filter_extended(spark, sf_dir):
    strict = quality.drop_bots(posts_documents(spark, sf_dir), strict=True)
    return strict.select("post_id", "author")


@query
def bot_anti_join(spark, sf_dir):
    posts = posts_documents(spark, sf_dir).select("post_id", "author")
    return quality.drop_listed_authors(posts, quality.bot_names(spark))


@query
def incremental_filter(spark, sf_dir):
    new = threads.newer_than(posts_events(spark, sf_dir), models.MARK)
    return new.select("post_id", "subreddit", stamp(F.col("created_utc")).alias("created_utc"))


@query
def text_fallback(spark, sf_dir):
    n = F.col("event_id")
    body = (
        F.when(n % 4 == 0, "").when(n % 4 == 1, F.lit(None)).when(n % 4 == 2, " ")
        .otherwise(F.col("event_type"))
    )
    title = F.when(n % 8 != 0, F.concat(F.lit("t "), "event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", text.body_or_title(body, title).alias("text")
    )


@query
def enrich_posts(spark, sf_dir):
    enriched = enrich(
        texts(spark, sf_dir),
        models.language_model(spark, sf_dir),
        models.LOAD_TIME,
        countries=models.KEYWORDS,
        leaders=models.LEADER_WORDS,
    )
    return enriched.select(
        "post_id", "author", "sentiment_score", "message_language", "country", "leader",
        stamp(F.col("last_processed")).alias("last_processed"),
    )


@query
def enrich_large_models(spark, sf_dir):
    """Models as tables: a lexicon as large as the line items, and 2,000 words of each language."""
    enriched = enrich(
        texts(spark, sf_dir),
        models.saved_profile(spark, sf_dir, models.LARGE_PROFILE),
        models.LOAD_TIME,
        sentiment_model=models.RULE_MODEL,
        lexicon=Dim(models.large_lexicon(spark, sf_dir)),
        countries=models.KEYWORDS,
        leaders=models.LEADER_WORDS,
    )
    return enriched.select("post_id", "sentiment_score", "message_language", "country", "leader")


@query
def enrich_defaults(spark, sf_dir):
    """Absent, empty and blank texts take the defaults."""
    number = F.col("post_id").cast("bigint")
    blanked = (
        F.when(number % 10 == 0, "").when(number % 10 == 1, F.lit(None))
        .when(number % 10 == 2, " \t\n ").otherwise(F.col("text"))
    )
    posts = texts(spark, sf_dir).withColumns(
        {"text": blanked, "author": F.lit("someone")}
    )
    enriched = enrich(
        posts,
        models.language_model(spark, sf_dir),
        models.LOAD_TIME,
        countries=models.KEYWORDS,
        leaders=models.LEADER_WORDS,
    )
    return enriched.select("post_id", "sentiment_score", "message_language", "country", "leader")


@query
def enrich_struct(spark, sf_dir):
    analysed = analysis_struct(
        texts(spark, sf_dir), models.language_model(spark, sf_dir)
    )
    return analysed.select(
        "post_id",
        F.col("analysis.sentiment").alias("sentiment"),
        F.col("analysis.language").alias("language"),
    )


@query
def sample_enriched(spark, sf_dir):
    """The enrichment is row by row, so the five rows are taken before it."""
    posts = quality.drop_bots(posts_documents(spark, sf_dir))
    first = ranking.top_k(posts, [F.col("post_id")], 5)
    return reports.sample_posts(
        enrich(
            first,
            models.language_model(spark, sf_dir),
            models.LOAD_TIME,
            countries=models.KEYWORDS,
            leaders=models.LEADER_WORDS,
        )
    )


# --- entities and lookups ------------------------------------------------------------------


@query
def detect_country(spark, sf_dir):
    tagged = entities.with_entities(posts_documents(spark, sf_dir), models.KEYWORDS)
    return tagged.select("post_id", "country")


@query
def detect_leader(spark, sf_dir):
    tagged = entities.with_entities(posts_documents(spark, sf_dir), leaders=models.LEADER_WORDS)
    return tagged.select("post_id", "leader")


def _by_table(spark, sf_dir, multiple):
    lists = [Dim(models.long_keywords(spark, sf_dir, rows)) for rows in (models.PHRASES, models.LEADER_WORDS)]
    tagged = entities.with_entities_by_table(posts_documents(spark, sf_dir), *lists, multiple)
    return tagged.select("post_id", "country", "leader")


@query
def detect_long_lists(spark, sf_dir):
    """First hits of keyword tables as long as the parts, by an index of letter groups."""
    return _by_table(spark, sf_dir, False)


@query
def detect_long_lists_all(spark, sf_dir):
    """All hits of the same tables."""
    return _by_table(spark, sf_dir, True)


@query
def detect_all_entities(spark, sf_dir):
    tagged = entities.with_entities(
        posts_documents(spark, sf_dir), models.KEYWORDS, models.LEADER_WORDS, multiple=True
    )
    return tagged.select("post_id", "country", "leader")


@query
def gazetteer_ngram_join(spark, sf_dir):
    gazetteer = Dim.inline(spark, models.PHRASES, ["alias", "value"])
    return entities.gazetteer_mentions(texts(spark, sf_dir), gazetteer)


@query
def gazetteer_full(spark, sf_dir):
    """All aliases of the gazetteers, in the documents' texts with a phrase put before each."""
    aliases = [
        (alias, value)
        for name, code, others in COUNTRY_GAZETTEER
        for alias, value in [(alias, code) for alias in [name, *others]]
    ]
    aliases += [(alias, name) for name, others in LEADER_GAZETTEER for alias in [name, *others]]
    aliases.append(("congo", "COD"))
    aliases.append(("congo", "COG"))
    gazetteer = Dim.inline(spark, aliases, ["alias", "value"])
    return entities.gazetteer_mentions(models.with_phrases(texts(spark, sf_dir)), gazetteer)


@query
def country_names_iso(spark, sf_dir):
    """Codes of names that are part of others, misspelt, or in no short list."""
    number = F.col("post_id").cast("bigint")
    names = F.array(*[F.lit(name) for name, _ in models.COUNTRY_NAMES])
    named = posts_documents(spark, sf_dir).select(
        F.get(names, F.pmod(number, F.lit(len(models.COUNTRY_NAMES))).cast("int")).alias("country")
    )
    counted = named.groupBy("country").agg(F.count(F.lit(1)).alias("posts"))
    return entities.country_iso(counted).select("country", "iso_alpha", "posts")


@query
def country_iso(spark, sf_dir):
    coded = entities.country_iso(reports.country_stats(loaded(spark, sf_dir)))
    return coded.select("country", "iso_alpha", six("avg_sentiment"), "post_count", six("avg_upvotes"))


@query
def normalize_country(spark, sf_dir):
    items = entities.explode_list(posts_events(spark, sf_dir).select("country"), "country", "item")
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("mentions")).select(
        "item", entities.normalize_country(F.col("item")).alias("country"), "mentions"
    )


@query
def normalize_leader(spark, sf_dir):
    items = entities.explode_list(posts_events(spark, sf_dir).select("leader"), "leader", "item")
    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("mentions"))
    aliases = Dim.inline(spark, list(LEADER_ALIASES.items()), ["alias", "canonical"])
    named = counts.withColumn("leader", F.col("item"))
    return entities.normalize_by_table(named, "leader", aliases, F.col("item"))


@query
def explode_countries(spark, sf_dir):
    rows = reports.explode_entities(loaded(spark, sf_dir).select("post_id", "country"), "country")
    return rows.select("post_id", F.col("entity").alias("country"))


@query
def explode_leaders(spark, sf_dir):
    rows = reports.explode_entities(loaded(spark, sf_dir).select("post_id", "leader"), "leader")
    return rows.select("post_id", F.col("entity").alias("leader"))


@query
def thread_join(spark, sf_dir):
    return threads.thread_rollup(posts_threads(spark, sf_dir))


# --- reports -------------------------------------------------------------------------------


@query
def headline_metrics(spark, sf_dir):
    return reports.headline_metrics(loaded(spark, sf_dir)).select(
        "total_posts", "countries", "leaders", six("avg_sentiment"), six("avg_upvotes")
    )


@query
def headline_by_days(spark, sf_dir):
    """The headline of ten days from the stored sketches of all days."""
    path = fresh_dir(spark, "sketches")
    sketches.daily_sketches(loaded(spark, sf_dir)).write.parquet(path)
    headline = sketches.headline_between(spark.read.parquet(path), models.FIRST_DAY, models.LAST_DAY)
    return headline.select("total_posts", "countries", "leaders", six("avg_sentiment"), six("avg_upvotes"))


@query
def country_stats(spark, sf_dir):
    return reports.country_stats(loaded(spark, sf_dir)).select(
        "country", six("avg_sentiment"), "post_count", six("avg_upvotes")
    )


@query
def country_table(spark, sf_dir):
    return reports.country_table(loaded(spark, sf_dir)).select("country", six("sentiment"), "posts")



def _leader_view(frame: DataFrame, *first: str) -> DataFrame:
    return frame.select(*first, "leader", "mentions", six("sentiment"), six("avg_upvotes"))


@query
def leader_stats(spark, sf_dir):
    return _leader_view(reports.leader_stats(loaded(spark, sf_dir)))


@query
def rank_overall(spark, sf_dir):
    return _leader_view(reports.rank_overall(loaded(spark, sf_dir)), "rank")


@query
def rank_positive(spark, sf_dir):
    return _leader_view(reports.rank_positive(loaded(spark, sf_dir)), "rank")


@query
def rank_negative(spark, sf_dir):
    return _leader_view(reports.rank_negative(loaded(spark, sf_dir)), "rank")


@query
def top3_leaders(spark, sf_dir):
    return _leader_view(reports.top_leaders(loaded(spark, sf_dir)))


@query
def daily_sentiment(spark, sf_dir):
    return reports.daily_sentiment(loaded(spark, sf_dir)).select("date", six("sentiment"), "posts")


@query
def sentiment_histogram(spark, sf_dir):
    return reports.sentiment_histogram(loaded(spark, sf_dir))


@query
def sentiment_bins(spark, sf_dir):
    """At most 30 bins of a round width."""
    return reports.auto_histogram(loaded(spark, sf_dir), "sentiment_score")


@query
def votes_bins(spark, sf_dir):
    """The same for votes, which have another range."""
    return reports.auto_histogram(loaded(spark, sf_dir), "upvotes")


@query
def activity_heatmap(spark, sf_dir):
    return reports.activity_heatmap(loaded(spark, sf_dir)).select(
        "day_of_week", "hour_of_day", "posts", six("sentiment")
    )


@query
def batch_counts(spark, sf_dir):
    return reports.batch_counts(posts_documents(spark, sf_dir))


@query
def post_comment_counts(spark, sf_dir):
    return reports.post_comment_counts(posts_events(spark, sf_dir))


@query
def source_counts(spark, sf_dir):
    return reports.source_counts(posts_events(spark, sf_dir), models.MARK)


def _post_view(frame: DataFrame) -> DataFrame:
    return frame.withColumn("created_utc", stamp(F.col("created_utc")))


@query
def top_positive(spark, sf_dir):
    return _post_view(reports.top_positive(loaded(spark, sf_dir)))


@query
def top_negative(spark, sf_dir):
    return _post_view(reports.top_negative(loaded(spark, sf_dir)))


@query
def top_upvoted(spark, sf_dir):
    return _post_view(reports.top_upvoted(loaded(spark, sf_dir)))


@query
def latest_per_source(spark, sf_dir):
    posts = posts_events(spark, sf_dir).select("post_id", "subreddit", "created_utc", "upvotes")
    order = [F.col("created_utc").desc(), F.col("post_id")]
    return _post_view(ranking.top_k_per_group(posts, ["subreddit"], order, 1))


@query
def comments_per_post_k(spark, sf_dir):
    comments = threads.comments_only(posts_threads(spark, sf_dir))
    return threads.newest_comments(comments, 3, [F.col("turn").desc()])


@query
def union_posts_comments(spark, sf_dir):
    items = posts_threads(spark, sf_dir).select("post_id", "author", "parent_post_id")
    batch = threads.batch_of(threads.posts_only(items), threads.comments_only(items))
    return threads.with_kind(batch)


@query
def dedupe_posts(spark, sf_dir):
    posts = posts_events(spark, sf_dir)
    again = posts.where(F.col("upvotes") >= 25).withColumns(
        {
            "upvotes": F.col("upvotes") + 1,
            "last_processed": F.col("last_processed") + F.make_interval(days=F.lit(1)),
        }
    )
    return _merged_view(quality.dedupe_posts(posts.unionByName(again)))


# --- scalar functions ----------------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    return texts(spark, sf_dir).select("post_id", text.clean_text(F.col("text")).alias("text"))


@query
def epoch_to_ts(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return table(spark, sf_dir, "events").select(
        "event_id", stamp(times.epoch_to_ts(seconds)).alias("created_utc")
    )


@query
def ttl_expiry(spark, sf_dir):
    now = F.lit(models.MARK)
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        stamp(times.expires_at(ts, F.col("value"))).alias("expires_at"),
        times.is_expired(ts, F.col("value"), now).alias("expired"),
    )


@query
def time_features(spark, sf_dir):
    return reports.time_features(posts_events(spark, sf_dir))


@query
def clip_scores(spark, sf_dir):
    return posts_events(spark, sf_dir).select(
        "post_id", scores.clip_score(F.col("sentiment_score")).alias("sentiment_score")
    )


@query
def format_report(spark, sf_dir):
    return reports.display_leaders(loaded(spark, sf_dir))


@query
def format_posts(spark, sf_dir):
    return reports.display_posts(loaded(spark, sf_dir))


# --- sentiment and language ----------------------------------------------------------------


@query
def lexicon_sentiment(spark, sf_dir):
    """The join path: any size of lexicon."""
    lexicon = Dim.inline(spark, list(LEXICON.items()), ["token", "valence"])
    return sentiment.sentiment_by_join(texts(spark, sf_dir), lexicon)


@query
def lexicon_sentiment_rules(spark, sf_dir):
    """The in-row path with all rules."""
    scored = sentiment.with_sentiment(texts(spark, sf_dir), models.RULE_MODEL)
    return scored.select("post_id", "sentiment_score")


@query
def lang_profile_train(spark, sf_dir):
    return models.language_profile(spark, sf_dir)


def _test_documents(spark, sf_dir):
    posts = texts(spark, sf_dir).select("post_id", "text", "expected_language")
    return posts.where(language.text_fold(F.col("text")) >= models.TRAIN_FOLDS)


@query
def detect_language(spark, sf_dir):
    """The in-row path, on documents the profile has not seen."""
    found = language.with_language(
        _test_documents(spark, sf_dir), models.language_model(spark, sf_dir)
    )
    return found.select("post_id", "expected_language", "message_language")


@query
def lang_confusion(spark, sf_dir):
    """The join path; the expected language travels with the key, not with the words."""
    test = _test_documents(spark, sf_dir).withColumn(
        "key", F.struct("post_id", "expected_language")
    )
    profile = models.saved_profile(spark, sf_dir)
    found = language.detect_by_join(test, profile, models.LANGUAGES, key="key")
    return language.confusion(
        found.select("key.expected_language", "message_language"), "expected_language"
    )


@query
def lang_rank_confusion(spark, sf_dir):
    """The out-of-place measure on documents the rank profiles have not seen; the expected language
    travels with the key."""
    profile = language.rank_profile(models.train_documents(spark, sf_dir), models.LANGUAGES, models.RANKED_GROUPS)
    test = _test_documents(spark, sf_dir).withColumn("key", F.struct("post_id", "expected_language"))
    found = language.detect_by_ranks(
        test, profile, models.LANGUAGES, models.RANKED_IN_TEXT, models.RANKED_GROUPS, key="key"
    )
    return language.confusion(found.select("key.expected_language", "message_language"), "expected_language")
