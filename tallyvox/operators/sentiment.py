"""Lexicon sentiment: a compound score in [-1, 1] per text.

Tokens and their neighbours are arrays inside the row, so scoring needs neither an explode nor
a shuffle and the text never moves. Membership tests compile to hash sets. A lexicon too large
for that is joined instead (`sentiment_by_join`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox import fixed_values as fixed
from tallyvox.functions.literals import rating, words
from tallyvox.functions.scores import clip_score
from tallyvox.functions.text import clean_text, opinion_tokens
from tallyvox.operators.lookup import Dim

MAX_LEXICON = 50_000


@dataclass(frozen=True)
class SentimentModel:
    lexicon: Mapping[str, float] = field(default_factory=lambda: dict(fixed.LEXICON))
    boosters: Mapping[str, float] = field(default_factory=lambda: dict(fixed.BOOSTERS))
    negators: Sequence[str] = tuple(fixed.NEGATORS)
    pivot: str = fixed.PIVOT_WORD

    def __post_init__(self):
        if not self.lexicon:
            raise ValueError("the lexicon is empty")
        if len(self.lexicon) > MAX_LEXICON:
            raise ValueError(f"use sentiment_by_join beyond {MAX_LEXICON} lexicon entries")


def lexicon_from(frame: DataFrame) -> dict[str, float]:
    """Read a lexicon table (token, valence) into a model, up to the checked bound."""
    unique = frame.groupBy("token").agg(F.max("valence").alias("valence"))
    rows = unique.limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"use sentiment_by_join beyond {MAX_LEXICON} lexicon entries")
    return {row.token: float(row.valence) for row in rows}


def compound(total: Column) -> Column:
    """Squash a sum of ratings into [-1, 1], four digits."""
    squashed = total / F.sqrt(total * total + fixed.NORMALIZATION_ALPHA)
    return F.round(clip_score(squashed), 4)


def with_sentiment(
    posts: DataFrame,
    model: SentimentModel | None = None,
    rules: bool = True,
    text: str = "text",
    into: str = "sentiment_score",
) -> DataFrame:
    """Add the compound score; texts that are blank, null or without a rated word get 0.0."""
    model = model or SentimentModel()
    tokens = _tokens(posts, text)
    hits = f"""array_compact(transform(_low, (t, i) ->
        CASE WHEN t IN ({words(model.lexicon)}) THEN i END))"""
    tokens = tokens.withColumn("_hits", F.expr(hits))
    any_hit = F.size("_hits") > 0
    if rules:  # facts about the whole text, found only where there is something to rate
        tokens = _whole_text(tokens, model, any_hit)
    rated = rating("get(_low, i)", model.lexicon)
    push, factor = _ruled(model)
    one = f"({rated} + sign({rated}) * ({push})) * {factor}" if rules else rated
    total = F.expr(f"aggregate(_hits, 0D, (acc, i) -> acc + {one})")
    summed = tokens.withColumn("_sum", F.when(any_hit, total))
    marked = _with_marks(F.col("_sum"), F.col("_clean")) if rules else F.col("_sum")
    return (
        summed.withColumn("_total", marked)
        .withColumn(into, F.coalesce(compound(F.col("_total")), F.lit(0.0)))
        .select(*posts.columns if into in posts.columns else [*posts.columns, into])
    )


def _tokens(posts: DataFrame, text: str) -> DataFrame:
    return (
        posts.withColumn("_clean", clean_text(F.col(text)))
        .withColumn("_tok", opinion_tokens(F.col("_clean")))
        .withColumn("_low", F.transform("_tok", lambda t: F.lower(t)))
    )


def _whole_text(tokens: DataFrame, model: SentimentModel, wanted: Column | None = None) -> DataFrame:
    """Whether some tokens, not all, are in capitals, and where the pivot word is."""
    caps = F.expr("size(filter(_tok, t -> upper(t) = t AND lower(t) != t))")
    pivot = F.array_position("_low", F.lit(model.pivot)) - 1
    if wanted is not None:
        caps, pivot = F.when(wanted, caps), F.when(wanted, pivot)
    tokens = tokens.withColumns({"_caps": caps, "_pivot": pivot})
    return tokens.withColumn("_mixed", F.col("_caps").between(1, F.size("_tok") - 1))


def _ruled(model: SentimentModel) -> tuple[str, str]:
    """SQL for what token `i` adds to a rating, in the rating's direction (capitals, boosters), and
    what it is multiplied by (negation and the pivot word)."""
    pushes = [f"CASE WHEN _mixed AND upper(get(_tok, i)) = get(_tok, i) THEN {fixed.CAPS_BOOST}D ELSE 0D END"]
    negated = []
    for distance, decay in enumerate(fixed.BOOST_DECAY, start=1):
        before = f"get(_low, i - {distance})"
        pushes.append(f"{rating(before, model.boosters)} * {decay}D")
        if model.negators:
            negated.append(f"coalesce({before} IN ({words(model.negators)}), false)")
    factor = f"""CASE WHEN {' OR '.join(negated) or 'false'} THEN {fixed.NEGATION_FACTOR}D ELSE 1D END
        * CASE WHEN _pivot < 0 OR i = _pivot THEN 1D
               WHEN i < _pivot THEN {fixed.BEFORE_PIVOT}D ELSE {fixed.AFTER_PIVOT}D END"""
    return " + ".join(pushes), factor


def _with_marks(total: Column, cleaned: Column) -> Column:
    marks = F.length(cleaned) - F.length(F.replace(cleaned, F.lit("!"), F.lit("")))
    push = F.least(marks, F.lit(fixed.MAX_EXCLAMATIONS)) * fixed.EXCLAMATION_BOOST
    return total + F.signum(total) * push


def sentiment_by_join(
    posts: DataFrame, lexicon: Dim, key: str = "post_id", text: str = "text"
) -> DataFrame:
    """(key, sentiment_score) from ratings alone, for a lexicon table of any size.

    Unrated tokens leave in the join's inner side; sums are formed per text before the shuffle. Of
    several rows for a token, the largest rating counts.
    """
    unique = lexicon.frame.groupBy("token").agg(F.max("valence").alias("valence"))
    unique = F.broadcast(unique) if lexicon.is_small() else unique
    tokens = posts.select(key, opinion_tokens(clean_text(F.col(text))).alias("_t")).select(
        key, F.explode_outer("_t").alias("_t")
    )
    rated = tokens.join(unique, F.lower("_t") == F.col("token"), "left")
    return (
        rated.groupBy(key)
        .agg(F.sum("valence").alias("_sum"))
        .select(key, F.coalesce(compound(F.col("_sum")), F.lit(0.0)).alias("sentiment_score"))
    )


def rules_by_join(
    texts: DataFrame, lexicon: Dim, key: str, model: SentimentModel | None = None, text: str = "text"
) -> DataFrame:
    """(key, sentiment_score) with all rules, for a lexicon table (token, valence) of any size; keys
    are unique. The model gives boosters, negators and pivot.

    What stands around a token is settled inside the row, so each token carries only its push and
    factor to the join with the lexicon. Hits come back in their order, and add up as
    `with_sentiment` adds them. Unrated tokens, but for the first of a text, leave before the shuffle.
    """
    model = model or SentimentModel()
    unique = lexicon.frame.groupBy("token").agg(F.max("valence").cast("double").alias("_valence"))
    unique = F.broadcast(unique) if lexicon.is_small() else unique
    tokens = _whole_text(_tokens(texts.select(key, text), text), model)
    push, factor = _ruled(model)
    around = f"transform(_low, (t, i) -> struct(i AS at, t AS token, {push} AS push, {factor} AS factor))"
    one = tokens.select(key, "_clean", F.explode_outer(F.expr(around)).alias("_t"))
    marked = F.when(F.coalesce(F.col("_t.at"), F.lit(0)) == 0, F.col("_clean"))  # once for each text
    one = one.select(key, marked.alias("_clean"), "_t.*")
    rated = one.join(unique, "token", "left").where("_valence IS NOT NULL OR coalesce(at, 0) = 0")
    value = F.expr("(_valence + sign(_valence) * push) * factor")
    hits = F.collect_list(F.when(F.col("_valence").isNotNull(), F.struct("at", value.alias("value"))))
    summed = rated.groupBy(key).agg(F.sort_array(hits).alias("_hits"), F.max("_clean").alias("_clean"))
    total = F.aggregate("_hits", F.lit(0.0), lambda acc, hit: acc + hit["value"])
    total = _with_marks(F.when(F.size("_hits") > 0, total), F.col("_clean"))
    return summed.select(key, F.coalesce(compound(total), F.lit(0.0)).alias("sentiment_score"))
