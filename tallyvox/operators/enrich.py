"""The enrichment step: bot filter, sentiment, language, entities, load time."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox import fixed_values as fixed
from tallyvox.functions.text import clean_text
from tallyvox.operators.entities import Keywords, with_entities
from tallyvox.operators.language import LanguageModel, identify, with_language
from tallyvox.operators.lookup import Dim
from tallyvox.operators.quality import drop_bots
from tallyvox.operators.sentiment import SentimentModel, rules_by_join, with_sentiment
from tallyvox.operators.texts import DIGEST, per_text


def enrich(
    posts: DataFrame,
    language_model: LanguageModel | DataFrame,
    load_time: datetime | None,
    sentiment_model: SentimentModel | None = None,
    lexicon: Dim | None = None,
    countries: Keywords = tuple(fixed.COUNTRY_KEYWORDS),
    leaders: Keywords = tuple(fixed.LEADER_KEYWORDS),
    strict_bots: bool = False,
    multiple: bool = False,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Works on tables and streams alike: every step is a projection or a filter.

    Models of any size come as tables: `lexicon` (token, valence) beside the rules of the sentiment
    model, and a profile as `train_profile` gives it for the language. Each different text is
    then joined with them once; a stream does that batch by batch (`foreachBatch`).

    `scorer` replaces the built-in sentiment with any DataFrame -> DataFrame function that sets
    `sentiment_score`, for example one that uses mapInPandas. The load time is a parameter, so a
    repeated run gives the same rows; with None, `last_processed` stays as it is.
    """
    kept = drop_bots(posts, strict_bots)
    if scorer:
        scored = scorer(kept)
    elif lexicon:
        scored = per_text(kept, lambda texts: rules_by_join(texts, lexicon, DIGEST, sentiment_model))
    else:
        scored = with_sentiment(kept, sentiment_model)
    if isinstance(language_model, LanguageModel):
        spoken = with_language(scored, language_model)
    else:
        spoken = per_text(scored, lambda texts: identify(texts, language_model, key=DIGEST).drop("text"))
    tagged = with_entities(spoken, countries, leaders, multiple)
    if load_time is None:
        return tagged
    return tagged.withColumn("last_processed", F.lit(load_time).cast("timestamp"))


def analysis_struct(
    posts: DataFrame, language_model: LanguageModel, sentiment_model: SentimentModel | None = None
) -> DataFrame:
    """Add `analysis`, a struct of sentiment and of the language of the cleaned text."""
    cleaned = posts.withColumn("_text", clean_text(F.col("text")))
    scored = with_language(
        with_sentiment(cleaned, sentiment_model, text="text", into="_score"),
        language_model,
        text="_text",
        into="_language",
    )
    return scored.withColumn(
        "analysis",
        F.struct(F.col("_score").alias("sentiment"), F.col("_language").alias("language")),
    ).drop("_text", "_score", "_language")
