"""Language identification with word (or letter group) profiles trained from labelled texts.

Training is two aggregations; scoring is naive Bayes over the distinct profile words of a text.
Log-probabilities are whole micro-units, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.functions.literals import words
from tallyvox.functions.text import letter_tokens, letter_trigrams
from tallyvox.operators.lookup import fits_broadcast
from tallyvox.operators.ranking import top_k_per_group
from tallyvox.session import fresh_dir

DEFAULT_LANGUAGE = "en"
MAX_MODEL_ROWS = 50_000
IN_ROW_GRAMS = 1_000  # beyond, a text's words are joined with the profile


Grams = Callable[[Column], Column]  # text to an array of words or letter groups


def gram_counts(
    labelled: DataFrame, text: str = "text", lang: str = "lang", grams: Grams = letter_tokens
) -> DataFrame:
    """(lang, gram, n): occurrences per language, summed before the shuffle."""
    # The outer form: for the plain one, the optimizer adds a filter that splits the text again.
    units = F.explode_outer(grams(F.col(text))).alias("gram")
    return (
        labelled.select(F.col(lang).alias("lang"), units)
        .where(F.col("gram").isNotNull())
        .groupBy("lang", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def train_profile(
    labelled: DataFrame,
    languages: Sequence[str],
    top: int = 100,
    text: str = "text",
    lang: str = "lang",
    grams: Grams = letter_tokens,
    counts_path: str | None = None,
) -> DataFrame:
    """(gram, lang, n, log_p): for each of the most frequent grams of any language, its smoothed
    log-probability in every language, `log((n + 1) / (total + distinct))`, in micro-units.

    The texts are read once: their counts are written to `counts_path` (default: a new scratch
    folder), and all later steps read the counts. Once the profile is stored, the counts can go.
    """
    spark = labelled.sparkSession
    path = counts_path or fresh_dir(spark, "gram-counts")
    known = labelled.where(F.col(lang).isin(list(languages)))
    gram_counts(known, text, lang, grams).write.parquet(path)
    counts = spark.read.schema("lang string, gram string, n bigint").parquet(path)
    # At most one row per language, so the broadcast below is bounded.
    totals = counts.groupBy("lang").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_grams")
    )
    frequent = (
        top_k_per_group(counts, ["lang"], [F.col("n").desc(), F.col("gram")], top)
        .select("gram")
        .distinct()
    )
    # Every profile gram gets a row for every language, seen there or not. The vocabulary is
    # cut to the profile before the join, so that the large side is only scanned.
    bounded = top * len(languages) <= MAX_MODEL_ROWS  # the most rows `frequent` can have
    seen = counts.join(F.broadcast(frequent) if bounded else frequent, "gram", "left_semi")
    complete = frequent.select(
        "gram", F.explode(F.array(*[F.lit(x) for x in languages])).alias("lang")
    )
    n = F.coalesce("n", F.lit(0))
    return (
        complete.join(seen, ["lang", "gram"], "left")
        .join(F.broadcast(totals), "lang")
        .select(
            "gram",
            "lang",
            n.cast("bigint").alias("n"),
            F.round(F.log((n + 1) / (F.col("total") + F.col("distinct_grams"))) * 1_000_000)
            .cast("bigint")
            .alias("log_p"),
        )
    )


@dataclass(frozen=True)
class LanguageModel:
    """A trained profile small enough to be compiled into a plan."""

    languages: tuple[str, ...]
    weights: dict[str, tuple[int, ...]]

    @classmethod
    def from_profile(cls, profile: DataFrame) -> LanguageModel:
        rows = profile.select("gram", "lang", "log_p").limit(MAX_MODEL_ROWS + 1).collect()
        if len(rows) > MAX_MODEL_ROWS:
            raise ValueError(f"use detect_by_join beyond {MAX_MODEL_ROWS} profile rows")
        languages = tuple(sorted({row.lang for row in rows}))
        slots: dict[str, list[int]] = {}
        for row in rows:
            slots.setdefault(row.gram, [0] * len(languages))[languages.index(row.lang)] = row.log_p
        # Likely words first: the lookup below scans from the front.
        order = sorted(slots, key=lambda gram: (-max(slots[gram]), gram))
        return cls(languages, {gram: tuple(slots[gram]) for gram in order})


def _best(scores: Sequence[Column], languages: Sequence[str]) -> Column:
    """The language with the highest score; equal scores go to the first name."""
    return F.array_min(
        F.array(
            *[
                F.struct((-score).alias("cost"), F.lit(name).alias("name"))
                for score, name in zip(scores, languages)
            ]
        )
    )["name"]


def with_language(
    posts: DataFrame,
    model: LanguageModel,
    text: str = "text",
    into: str = "message_language",
    grams: Grams = letter_tokens,
) -> DataFrame:
    """Add the language inside the row: no join, no shuffle, the text stays where it is.

    A hash-set test keeps the profile words of a text; each is then looked up once, and one pass
    sums the scores of all languages. Meant for up to `IN_ROW_GRAMS` words (see `identify`).
    """
    if not model.weights:
        return posts.withColumn(into, F.lit(DEFAULT_LANGUAGE))
    profile = words(model.weights)
    known = (
        posts.withColumn("_grams", F.array_distinct(grams(F.col(text))))
        .withColumn("_known", F.expr(f"filter(_grams, g -> g IN ({profile}))"))
        .withColumn("_at", F.expr(f"transform(_known, g -> array_position(array({profile}), g))"))
    )
    slots = range(len(model.languages))
    weights = [", ".join(f"{w[slot]}L" for w in model.weights.values()) for slot in slots]
    zero = ", ".join(f"0L AS s{i}" for i in slots)
    step = ", ".join(f"acc.s{i} + element_at(array({weights[i]}), int(p)) AS s{i}" for i in slots)
    known = known.withColumn(
        "_sums", F.expr(f"aggregate(_at, struct({zero}), (acc, p) -> struct({step}))")
    )
    scores = [F.col(f"_sums.s{i}") for i in slots]
    best = F.when(F.size("_known") > 0, _best(scores, model.languages))
    return known.withColumn(into, F.coalesce(best, F.lit(DEFAULT_LANGUAGE))).select(
        *posts.columns if into in posts.columns else [*posts.columns, into]
    )


def detect_by_join(
    posts: DataFrame,
    profile: DataFrame,
    languages: Sequence[str],
    key: str = "post_id",
    text: str = "text",
    grams: Grams = letter_tokens,
) -> DataFrame:
    """(key, message_language) for a profile of any size: one row per distinct word of a text,
    joined to one row per profile word, summed per text before the shuffle."""
    names = sorted(languages)
    wide = profile.groupBy("gram").agg(
        *[F.max(F.when(F.col("lang") == name, F.col("log_p"))).alias(f"w{i}") for i, name in enumerate(names)]
    )
    if fits_broadcast(profile):
        wide = F.broadcast(wide)
    units = posts.select(
        key, F.explode_outer(F.array_distinct(grams(F.col(text)))).alias("gram")
    )
    sums = (
        units.join(wide, "gram", "left")
        .groupBy(key)
        .agg(F.count("w0").alias("hits"), *[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(names))])
    )
    best = F.when(F.col("hits") > 0, _best([F.col(f"s{i}") for i in range(len(names))], names))
    return sums.select(key, F.coalesce(best, F.lit(DEFAULT_LANGUAGE)).alias("message_language"))


def identify(
    posts: DataFrame,
    profile: DataFrame,
    languages: Sequence[str] | None = None,
    key: str = "post_id",
    text: str = "text",
    into: str = "message_language",
    grams: Grams = letter_tokens,
) -> DataFrame:
    """Add the language with a profile of any size: in the row while the profile has at most
    `IN_ROW_GRAMS` words, by join and the unique `key` beyond. Both give the same. `languages`
    are those of the profile, unless given."""
    if languages is None:  # a row for each language
        languages = sorted(row.lang for row in profile.select("lang").distinct().collect())
    if profile.select("gram").distinct().count() <= IN_ROW_GRAMS:
        return with_language(posts, LanguageModel.from_profile(profile), text, into, grams)
    found = detect_by_join(posts, profile, languages, key, text, grams)
    found = found.withColumnRenamed("message_language", into)
    return posts.drop(into).join(found, key, "left")


# --- rank profiles ---------------------------------------------------------------------------


def rank_profile(
    labelled: DataFrame,
    languages: Sequence[str],
    top: int = 1500,
    text: str = "text",
    lang: str = "lang",
    grams: Grams = letter_trigrams,
) -> DataFrame:
    """(gram, lang, place): the most frequent letter groups of each language, from place 1; ties by name.
    The texts are read once: the profile, of at most `top` rows for each language, is written and read again."""
    known = labelled.where(F.col(lang).isin(list(languages)))
    order = [F.col("n").desc(), F.col("gram")]
    best = top_k_per_group(gram_counts(known, text, lang, grams), ["lang"], order, top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    spark, path = labelled.sparkSession, fresh_dir(labelled.sparkSession, "rank-profile")
    best.select("gram", "lang", place.alias("place")).write.parquet(path)
    return spark.read.schema("gram string, lang string, place int").parquet(path)


def _ranked_grams(text: Column, frame: DataFrame, grams: Grams, top: int) -> DataFrame:
    """Add `_ranked`: the `top` most frequent letter groups of the text, ties by name. All in the row: the
    sorted groups fall into runs, whose lengths are the counts."""
    firsts = "filter(sequence(0, size(_sorted)), i -> i = size(_sorted) OR i = 0 OR _sorted[i] != _sorted[i - 1])"
    count = "_firsts[j] - _firsts[j + 1]"  # less than zero, so that the largest comes first
    runs = f"transform(sequence(0, size(_firsts) - 2), j -> struct({count} AS n, _sorted[_firsts[j]] AS gram))"
    return (
        frame.withColumn("_sorted", F.sort_array(grams(text)))
        .withColumn("_firsts", F.when(F.size("_sorted") > 0, F.expr(firsts)))
        .withColumn("_runs", F.expr(f"sort_array({runs})"))
        .withColumn("_ranked", F.transform(F.slice("_runs", 1, top), lambda r: r["gram"]))
        .drop("_sorted", "_firsts", "_runs")
    )


def detect_by_ranks(
    posts: DataFrame,
    profile: DataFrame,
    languages: Sequence[str],
    top: int = 300,
    penalty: int = 1500,
    key: str = "post_id",
    text: str = "text",
    grams: Grams = letter_trigrams,
) -> DataFrame:
    """(key, message_language) by the out-of-place measure of Cavnar and Trenkle (1994): the `top`
    letter groups of a text take places as those of a language do; the distance is the sum of the
    differences, or `penalty` for a group the language's profile lacks. Ties go to the first
    name, texts without letters to the default. Keys are unique. A text's groups are counted in its
    row; only those that take a place leave it."""
    names = sorted(languages)
    wide = profile.groupBy("gram").agg(
        *[F.max(F.when(F.col("lang") == name, F.col("place"))).alias(f"p{i}") for i, name in enumerate(names)]
    )
    if fits_broadcast(profile):
        wide = F.broadcast(wide)
    ranked = _ranked_grams(F.col(text), posts.select(key, text), grams, top)
    placed = ranked.select(key, F.posexplode_outer("_ranked").alias("_at", "gram"))
    placed = placed.withColumn("place", F.col("_at") + 1)
    apart = [
        F.sum(F.when(F.col("gram").isNotNull(), F.coalesce(F.abs(F.col("place") - F.col(f"p{i}")), F.lit(penalty))))
        for i in range(len(names))
    ]
    sums = placed.join(wide, "gram", "left").groupBy(key).agg(*[a.alias(f"d{i}") for i, a in enumerate(apart)])
    best = F.when(F.col("d0").isNotNull(), _best([-F.col(f"d{i}") for i in range(len(names))], names))
    return sums.select(key, F.coalesce(best, F.lit(DEFAULT_LANGUAGE)).alias("message_language"))


def confusion(predicted: DataFrame, expected: str, found: str = "message_language") -> DataFrame:
    """Counts per pair of expected and found language, with the share within the expected one."""
    pairs = predicted.groupBy(expected, found).agg(F.count(F.lit(1)).alias("n"))
    # One row per pair of language codes; the window runs over that small table.
    total = F.sum("n").over(Window.partitionBy(expected))
    return pairs.withColumn("share", F.round(F.col("n") / total, 6))


def text_fold(text: Column) -> Column:
    """0 to 15 from a digest of the text, so that exact copies share a fold."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 1), 16, 10).cast("int")
