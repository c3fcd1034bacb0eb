"""Country and leader tagging, list explosion and name normalisation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvox import fixed_values as fixed
from tallyvox.functions.literals import literal, words
from tallyvox.functions.text import strip, title_case, word_tokens
from tallyvox.operators.lookup import Dim, fits_broadcast, inline_frame
from tallyvox.operators.texts import DIGEST
from tallyvox.session import fresh_dir

# Up to this many keywords are compiled as one chain; longer lists are one constant array.
MAX_CHAIN = 64

Keywords = Sequence[tuple[str, str]]


def _hits(keywords: Keywords) -> str:
    """SQL for the entries of a long keyword list that occur in `_lowered`, in list order."""
    entries = ", ".join(
        f"struct({literal(keyword)} AS keyword, {literal(value)} AS value)"
        for keyword, value in keywords
    )
    return f"filter(array({entries}), k -> contains(_lowered, k.keyword))"


def first_hit(keywords: Keywords) -> Column:
    """Value of the first keyword of the list that occurs in `_lowered` as a substring.

    List order decides, not the position in the text. A short list is a chain that stops at the
    first hit. No list needs a join, so none adds a shuffle.
    """
    if not keywords:
        return F.lit(None).cast("string")
    if len(keywords) > MAX_CHAIN:
        return F.expr(f"get({_hits(keywords)}, 0).value")
    cases = " ".join(
        f"WHEN contains(_lowered, {literal(keyword)}) THEN {literal(value)}"
        for keyword, value in keywords
    )
    return F.expr(f"CASE {cases} END")


def all_hits(keywords: Keywords) -> Column:
    """All values with a hit, distinct, sorted and joined by commas; null without a hit."""
    if len(keywords) > MAX_CHAIN:
        found = F.expr(f"transform({_hits(keywords)}, k -> k.value)")
        joined = F.array_join(F.array_sort(F.array_distinct(found)), ",")
    else:
        by_value: dict[str, list[str]] = {}
        for keyword, value in keywords:
            by_value.setdefault(value, []).append(keyword)
        hits = []
        for value in sorted(by_value):
            any_hit = F.lit(False)
            for keyword in by_value[value]:
                any_hit = any_hit | F.col("_lowered").contains(keyword)
            hits.append(F.when(any_hit, value))
        joined = F.concat_ws(",", *hits)
    return F.when(joined != "", joined)


def with_entities(
    posts: DataFrame,
    countries: Keywords = tuple(fixed.COUNTRY_KEYWORDS),
    leaders: Keywords = tuple(fixed.LEADER_KEYWORDS),
    multiple: bool = False,
) -> DataFrame:
    """Set `country` and `leader` from `text`."""
    match = all_hits if multiple else first_hit
    return (
        posts.withColumn("_lowered", F.lower("text"))
        .withColumns({"country": match(countries), "leader": match(leaders)})
        .drop("_lowered")
    )


def explode_list(posts: DataFrame, column: str, into: str) -> DataFrame:
    """One row per item of a comma list, trimmed, without blank items; null lists vanish."""
    item = F.explode_outer(F.split(F.coalesce(F.col(column), F.lit("")), ","))
    return (
        posts.withColumn(into, item).withColumn(into, strip(F.col(into))).where(F.col(into) != "")
    )


def _by_alias(key: Column, aliases: Mapping[str, str], default: Column) -> Column:
    groups: dict[str, list[str]] = {}
    for alias, canonical in aliases.items():
        groups.setdefault(canonical, []).append(alias)
    chain = None
    for canonical, keys in groups.items():
        hit = key.isin(keys)
        chain = F.when(hit, canonical) if chain is None else chain.when(hit, canonical)
    return default if chain is None else chain.otherwise(default)


def normalize_country(
    name: Column, aliases: Mapping[str, str] = fixed.COUNTRY_ALIASES
) -> Column:
    """Canonical name by upper-cased alias, else title case. Null and '' stay as they are."""
    key = F.upper(strip(name))
    return F.when(name == "", name).otherwise(_by_alias(key, aliases, title_case(key)))


def normalize_leader(name: Column, aliases: Mapping[str, str] = fixed.LEADER_ALIASES) -> Column:
    """Canonical name by exact, case-sensitive alias, else the name itself."""
    return _by_alias(name, aliases, name)


def normalize_by_table(posts: DataFrame, column: str, aliases: Dim, key: Column) -> DataFrame:
    """As above with an alias table (columns alias, canonical) of any size. Of several rows for an
    alias, the smallest name counts."""
    unique = aliases.frame.groupBy(F.col("alias").alias("_alias")).agg(F.min("canonical").alias("canonical"))
    dim = F.broadcast(unique) if aliases.is_small() else unique
    return (
        posts.join(dim, key == F.col("_alias"), "left")
        .withColumn(column, F.coalesce("canonical", F.col(column)))
        .drop("_alias", "canonical")
    )


@cache
def iso_countries() -> tuple[tuple[str, str, str], ...]:
    """(name, alpha-2, alpha-3) of every ISO 3166-1 country, from the locale data of the JVM; names
    with accents also without them."""
    locales = SparkSession.active()._jvm.java.util.Locale
    rows = []
    for alpha2 in locales.getISOCountries():
        country = locales("", alpha2)
        name, alpha3 = country.getDisplayCountry(locales.ENGLISH), country.getISO3Country()
        rows.append((name, alpha2, alpha3))
        plain = unicodedata.normalize("NFD", name).encode("ascii", "ignore").decode()
        if plain != name:
            rows.append((plain, alpha2, alpha3))
    return tuple(rows)


def _words(text: str) -> str:
    return " ".join(re.findall(r"\w+", text.lower()))


def country_iso(
    stats: DataFrame,
    column: str = "country",
    special: Mapping[str, str] = fixed.ISO_SPECIAL,
    countries: Sequence[tuple[str, str, str]] | None = None,
    max_edits: int = 1,
) -> DataFrame:
    """Add `iso_alpha` and drop rows without a code.

    Order: special cases; exact name or code, ignoring case; the earliest place where the whole
    text stands as words inside a name; for five letters or more, the nearest name within
    `max_edits`. Ties go to the first alpha-2 code. The list defaults to all of ISO 3166-1.

    All of that is one equi-join of each different text's keys: itself, and what is left of it without
    up to `max_edits` letters, which two texts within so many edits share. Edits are then counted.
    """
    rows = (iso_countries() if countries is None else tuple(countries)) or [("", "", "")]
    query = F.lower(strip(F.col(column)))
    found: dict[tuple[str, str, str], int] = {}  # text, alpha-2, code: cost
    for name, alpha2, alpha3 in rows:
        parts = _words(name).split()
        inside = [(i, j) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)]
        costs = [(" ".join(parts[i:j]), len(" ".join(["", *parts[:i]])) + 1) for i, j in inside]
        for text, cost in [*costs, *((t.lower(), 0) for t in (name, alpha2, alpha3))]:
            place = (text, alpha2.lower(), alpha3)
            found[place] = min(cost, found.get(place, cost))
    spark = stats.sparkSession
    whole = inline_frame(spark, [(*k, c) for k, c in found.items()], ["key", "a", "code", "cost"])
    whole = whole.select("key", "a", "code", "cost", F.lit(None).cast("string").alias("name"))
    names = inline_frame(spark, sorted({(n.lower(), a.lower(), c) for n, a, c in rows}), ["name", "a", "code"])
    shortened = names.select(
        F.explode(_shortened(F.col("name"), max_edits)).alias("key"), "a", "code", F.lit(None).cast("int").alias("cost"), "name"
    )
    asked = stats.select(F.col(column).alias("_asked"), query.alias("_query")).where("_query != ''").distinct()
    # Whole texts meet whole texts; those of five letters or more, shortened ones meet shortened ones.
    own = F.array(F.struct(F.lit(True).alias("whole"), F.col("_query").alias("key")))
    less = F.transform(_shortened(F.col("_query"), max_edits), lambda k: F.struct(F.lit(False).alias("whole"), k.alias("key")))
    keys = asked.select("_asked", "_query", F.inline(F.when(F.length("_query") >= 5, F.concat(own, less)).otherwise(own)))
    table = whole.withColumn("whole", F.lit(True)).unionByName(shortened.withColumn("whole", F.lit(False)))
    edits = F.levenshtein(F.col("_query"), F.col("name"), max_edits)
    cost = F.coalesce(F.col("cost"), F.when(edits >= 0, edits + 1000))
    # As many rows as the given list has texts within `max_edits`: a constant of the program.
    hits = keys.join(F.broadcast(table), ["whole", "key"]).withColumn("cost", cost).where("cost IS NOT NULL")
    best = hits.groupBy("_asked").agg(F.min(F.struct("cost", "a", "code"))["code"].alias("_code"))
    # The special cases are a case-sensitive alias list whose default is the lookup.
    code = _by_alias(F.col(column), special, F.col("_code"))
    coded = stats.join(best, F.col(column) == F.col("_asked"), "left").withColumn("iso_alpha", code)
    return coded.drop("_asked", "_code").where(F.col("iso_alpha").isNotNull())


def _shortened(text: Column, letters: int) -> Column:
    """The text and all that is left of it without up to `letters` letters."""
    found = F.array(text)
    for _ in range(letters):
        without = F.transform(
            found,
            lambda t: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
                lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))),
            ),
        )
        found = F.array_distinct(F.concat(found, F.flatten(without)))
    return found


# --- keyword tables of any size --------------------------------------------------------------

GRAM = 4
BLOCK = 64  # characters of a text that are looked through together, at least
SAMPLE_TEXTS = 2_000  # in which grams are counted; has a say in the cost, not in the result
# A match for each character: what stands from there on, a gram or, at the end, up to a gram.
WHOLE_GRAMS, PIECES = f"(?s)(?=(.{{{GRAM}}})).", f"(?s)(?=(.{{1,{GRAM}}}))."


def _runs(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _starts(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(gram, offset, length), different ones: each keyword is filed under the gram of its own that fewest
    sampled texts hold, the first of them on a tie, and of that only the place and the keyword's length are kept."""
    n = texts.count()
    sample = texts if n <= SAMPLE_TEXTS else texts.sample(SAMPLE_TEXTS / n, seed=0)
    grams = sample.select(F.explode_outer(F.array_distinct(_runs("_text", WHOLE_GRAMS))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    # Rarer ones count as absent, so the sample's size bounds what is broadcast.
    common = counts.where(F.col("n") >= max(2, min(n, SAMPLE_TEXTS) // 200))
    places = keywords.select("keyword").distinct().select(
        "keyword", F.posexplode_outer(_runs("keyword", WHOLE_GRAMS)).alias("offset", "gram")
    )
    cost = F.coalesce("n", F.lit(0)) * (1 << 31) + F.col("offset")
    best = places.join(F.broadcast(common), "gram", "left").groupBy("keyword").agg(F.min(cost).alias("_cost"))
    offset = (F.col("_cost") % (1 << 31)).cast("int")
    filed = best.select(
        F.col("keyword").substr(offset + 1, F.lit(GRAM)).alias("gram"),
        offset.alias("offset"),
        F.length("keyword").alias("length"),
    )
    path = fresh_dir(texts.sparkSession, "keyword-starts")
    filed.distinct().write.parquet(path)
    return texts.sparkSession.read.schema("gram string, offset int, length int").parquet(path)


def _long_runs(texts: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """(key, keyword): the runs of a text that have a keyword's gram in its place and a keyword's length.

    Texts are cut into blocks that reach into the next one as far as a run that begins in them can, so a
    place carries its block, never the whole text. If the keywords have few grams, blocks without one leave
    before their places are looked at. A gram meets by its hash: what two grams with one hash let through
    falls out with the whole keyword."""
    most = starts.agg(F.max("length").alias("length"), F.max("offset").alias("offset")).first()
    if most.length is None:
        return texts.select(key, F.lit("").alias("keyword")).limit(0)
    size = max(BLOCK, most.length // 2)
    # The outer form: for the plain one, the optimizer adds a filter that cuts the text again.
    cut = _runs("_text", f"(?s)(?=(.{{1,{size + most.length - 1}}})).{{1,{size}}}")
    blocks = texts.select(key, F.explode_outer(cut).alias("_block")).where(F.length("_block") >= GRAM)
    few = [row.gram for row in starts.select("gram").distinct().limit(MAX_CHAIN + 1).collect()]
    if len(few) <= MAX_CHAIN:
        blocks = blocks.where(" OR ".join(f"contains(_block, {literal(gram)})" for gram in sorted(few)))
    starts = starts.withColumn("gram", F.xxhash64("gram"))
    last = F.least(F.length("_block") - GRAM, F.lit(size - 1 + most.offset))
    places = blocks.select(key, "_block", F.explode_outer(F.sequence(F.lit(0), last)).alias("_at"))
    gram = F.xxhash64(F.col("_block").substr(F.col("_at") + 1, F.lit(GRAM))).alias("gram")
    side = F.broadcast if fits_broadcast(starts) else lambda frame: frame
    spots = places.select(key, "_block", "_at", gram).join(side(starts), "gram")
    begin = F.col("_at") - F.col("offset")
    inside = (begin >= 0) & (begin < size) & (begin + F.col("length") <= F.length("_block"))
    return spots.where(inside).select(key, F.col("_block").substr(begin + 1, F.col("length")).alias("keyword")).distinct()


def _short_runs(texts: DataFrame, short: DataFrame, key: str) -> DataFrame:
    """(key, keyword) for keywords shorter than a gram: a few are searched one by one, of more all runs
    as long as one are looked up."""
    few = [row.keyword for row in short.select("keyword").distinct().limit(MAX_CHAIN + 1).collect()]
    if len(few) <= MAX_CHAIN:
        listed = f"CAST(array({words(sorted(few))}) AS array<string>)"
        found = F.expr(f"filter({listed}, k -> contains(_text, k))")
        return texts.select(key, F.explode_outer(found).alias("keyword"))
    sizes = [row.n for row in short.select(F.length("keyword").alias("n")).distinct().collect()]  # 0 to 3
    pieces = texts.select(key, _runs("_text", PIECES).alias("_pieces"), F.array(F.lit("")).alias("_empty"))
    runs = [F.expr(f"transform(_pieces, p -> substring(p, 1, {n}))") for n in sizes if n]
    own = F.array_distinct(F.concat("_empty", *runs))
    side = F.broadcast if fits_broadcast(short) else lambda frame: frame
    every = pieces.where("_pieces IS NOT NULL").select(key, F.explode_outer(own).alias("keyword"))
    return every.join(side(short.select("keyword").distinct()), "keyword", "left_semi").select(key, "keyword")


def _occurring(texts: DataFrame, lists: Mapping[str, Dim], key: str, multiple: bool, text: str = "text") -> DataFrame:
    """The key of each text with a hit, and a column for each list, as `keyword_hits` gives it."""
    table = None
    for name, dim in lists.items():
        lowered = F.lower("keyword").alias("keyword")
        rows = dim.frame.select(F.lit(name).alias("_list"), "priority", lowered, "value").where("keyword IS NOT NULL")
        table = rows if table is None else table.unionByName(rows)
    texts = texts.select(key, F.lower(text).alias("_text"))
    long, short = table.where(F.length("keyword") >= GRAM), table.where(F.length("keyword") < GRAM)
    runs = _long_runs(texts, _starts(texts, long), key).unionByName(_short_runs(texts, short, key))
    side = F.broadcast if all(dim.is_small() for dim in lists.values()) else lambda frame: frame
    hits = runs.join(side(table), "keyword")
    entry, found = F.struct("priority", "keyword", "value"), []
    for name in lists:
        listed = F.col("_list") == name
        if multiple:
            joined = F.array_join(F.array_sort(F.collect_set(F.when(listed, F.col("value")))), ",")
            found.append(F.when(joined != "", joined).alias(name))
        else:
            found.append(F.min(F.when(listed, entry))["value"].alias(name))
    return hits.groupBy(key).agg(*found)


def keyword_hits(
    texts: DataFrame, keywords: Dim, key: str, multiple: bool = False, text: str = "text"
) -> DataFrame:
    """(key, value) as `first_hit`, or `all_hits`, gives it, for a keyword table of any size (columns priority,
    keyword, value); null without a hit. Keys are unique.

    A text's grams are looked up among the places they have in keywords; what stands there, cut to a
    keyword's length, meets the table by an equi-join on the whole keyword. So a gram that many keywords
    share costs a text as many rows as these keywords have lengths and places of it, not one for each keyword.
    """
    return texts.select(key).join(_occurring(texts, {"value": keywords}, key, multiple, text), key, "left")


def with_entities_by_table(
    posts: DataFrame, countries: Dim, leaders: Dim, multiple: bool = False
) -> DataFrame:
    """`with_entities` with keyword tables of any size, both looked up in one pass over the texts. Posts
    that share a text, or a key, keep their rows; a null text counts as empty. The priorities of both
    tables have one type."""
    text = F.coalesce("text", F.lit(""))
    marked = posts.withColumn(DIGEST, F.md5(text.cast("binary")))
    texts = marked.select(DIGEST, text.alias("text"))
    found = _occurring(texts, {"country": countries, "leader": leaders}, DIGEST, multiple)
    return marked.drop("country", "leader").join(found, DIGEST, "left").drop(DIGEST)


def gazetteer_mentions(posts: DataFrame, gazetteer: Dim, key: str = "post_id") -> DataFrame:
    """Whole-word mentions, longest alias first, by an equi-join on the whole alias.

    `gazetteer` has columns alias, value; aliases have any number of words. Word positions whose
    word starts no alias leave first; the others look up a phrase of each length that an alias
    with that first word has. A mention inside a longer mention is dropped; several values of one
    alias all count. Only possible starts and hits are shuffled. Returns (key, value, mentions).
    """
    aliases = (
        gazetteer.frame.select("value", word_tokens(F.col("alias")).alias("_w"))
        .where(F.size("_w") > 0)
        .select(
            "value",
            F.array_join("_w", " ").alias("_phrase"),
            F.get("_w", F.lit(0)).alias("_word"),
            F.size("_w").alias("_len"),
        )
        .distinct()
    )
    side = F.broadcast if gazetteer.is_small() else lambda frame: frame
    firsts = aliases.groupBy("_word").agg(F.collect_set("_len").alias("_lens"))
    longest = aliases.agg(F.max("_len")).first()[0] or 0
    # The outer form: for the plain one, the optimizer adds a filter that splits the text again.
    texts = posts.select(key, word_tokens(F.col("text")).alias("_words"))
    positions = texts.select(key, "_words", F.posexplode_outer("_words").alias("_start", "_word"))
    # The words from here on, as many as an alias can have: never the whole text.
    ahead = F.slice("_words", F.col("_start") + 1, longest).alias("_ahead")
    possible = (
        positions.select(key, "_start", "_word", ahead)
        .join(side(firsts), "_word")
        .select(key, "_start", "_ahead", F.explode("_lens").alias("_len"))
        .where(F.size("_ahead") >= F.col("_len"))
        .withColumn("_phrase", F.array_join(F.slice("_ahead", F.lit(1), F.col("_len")), " "))
    )
    found = possible.drop("_ahead", "_len").join(side(aliases), "_phrase")
    hits = found.groupBy(key, "_start", (F.col("_start") + F.col("_len")).alias("_end")).agg(
        F.collect_list("value").alias("_values")
    )
    # One text's hits only: a longer mention starts earlier or at the same word.
    earlier = (
        Window.partitionBy(key)
        .orderBy(F.col("_start"), F.col("_end").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        hits.withColumn("_covered", F.max("_end").over(earlier))
        .where(F.col("_covered").isNull() | (F.col("_end") > F.col("_covered")))
        .select(key, F.explode("_values").alias("value"))
        .groupBy(key, "value")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )
