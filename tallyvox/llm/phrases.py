"""Collocations by SON partitioning.

The texts are cut into shards that fit a task. Each is mined completely, level by level, at the
support lowered in proportion to its share of the language: a phrase that reaches the support
over all texts reaches the lowered one in some shard, so the union of what the shards report misses none.
The candidates are then counted in full by a second pass.

Where a language has so many shards that the lowered support is one (from half the support on), its shards
report all their phrases, each with its count; the union adds them up, and no second count is needed.

Inside a shard words are numbers, phrases of one length are numbered by sorting, and a phrase is looked at
only if both its parts of one word less are frequent enough there. Phrases leave the shard as text, in
buckets that the words decide, so no hash stands for a phrase and a frequent one is a row of each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.llm.common import stored
from tallyvox.operators.ranking import top_k_per_group

SHARD_BYTES = 8 << 20  # of texts that a task holds, of all languages
SHARD_WORDS = 1 << 21  # sorted at once
MAX_LANGUAGES = 100_000  # with their sizes, broadcast; more are joined by shuffle
BREAKS = ".,;:!?\n\x0b\x0c\r"  # end a piece
UND = "und"  # the language of null
SCALE = 1_000_000
KEYS = ["lang", "words", "phrase"]
OUT = "lang string, words int, phrase string, count long"
NAMES = [*KEYS, "count"]
REPORT = "lang string, open boolean, bucket long, words int, phrases binary, counts binary"
REPORT_NAMES = [field.split()[0] for field in REPORT.split(", ")]
BUCKET_BYTES = 2 << 20  # of a language's texts, for each bucket of its phrases
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BLANK, NOTHING, LINE_END = (pa.scalar(x, pa.large_binary()) for x in (b" ", b"", b"\n"))
TO_BREAK = bytes.maketrans(BREAKS.encode() + b"\t", b"." * len(BREAKS) + b" ")


# --- a shard ---------------------------------------------------------------------------------


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """(different words, the number of each word in order): -1 between pieces and texts."""
    joined = "\n".join(t or "" for t in texts).encode("utf-8", "surrogatepass")
    plain = joined.lower().translate(TO_BREAK).replace(b".", b" . ")
    found = pc.split_pattern(pa.array([plain], pa.large_binary()), pattern=b" ").flatten().dictionary_encode()
    words, codes = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
    blank, stop = (pc.index(words, pa.scalar(w, words.type)).as_py() for w in (b"", b"."))
    codes = codes[codes != blank]
    return words, np.where(codes == stop, -1, codes)


def mined(codes: np.ndarray, longest: int, support: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words: (words, a place of each phrase, its count), of all phrases of up to
    `longest` words that occur at least `support` times."""
    places = np.flatnonzero(codes >= 0)
    keys, base = codes[places].astype(np.int64), int(codes.max(initial=0)) + 1
    for words in range(1, longest + 1):
        order = np.argsort(keys)
        new = np.diff(keys[order], prepend=-1) != 0
        starts = np.flatnonzero(new)
        counts = np.diff(starts, append=len(keys))
        often = counts >= support
        yield words, places[order[starts[often]]], counts[often]
        if words == longest:
            return
        # A longer phrase starts where this one does, if another frequent one starts a word later.
        phrase = np.cumsum(new) - 1
        kept = often[phrase]
        number = np.full(len(codes) + 1, -1, np.int64)
        number[places[order[kept]]] = phrase[kept]
        grown = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
        keys = number[grown] * base + codes[grown + words]
        places = grown


def shard_counts(
    texts: list[str | None], longest: int, support: int, buckets: int
) -> Iterator[pa.RecordBatch]:
    """(bucket, words, phrases, counts), a row for each bucket and number of words: the shard's phrases that
    occur at least `support` times, each with a line end after it, and their counts. The number of all
    its words goes as an empty phrase of none. A phrase's words decide its bucket."""
    words, codes = words_of(texts)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))

    def placed(codes: np.ndarray, support: int, sign: int) -> Iterator[pa.RecordBatch]:
        for size, at, counts in mined(codes, longest, support):
            mixed = np.zeros(len(at), np.uint64)
            for i in range(size):
                mixed = (mixed ^ hashes[codes[at + i]]) * FACTOR
            bucket = (mixed >> np.uint64(16)).astype(np.int64) % buckets
            order = np.argsort(bucket)
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            parts = [words.take(pa.array(codes[at[order] + i])).cast(pa.large_binary()) for i in range(size)]
            lines = pc.binary_join_element_wise(pc.binary_join_element_wise(*parts, BLANK), NOTHING, LINE_END)
            yield _rows(bucket[order[starts]], size, lines, sign * counts[order], starts)

    yield _rows(np.zeros(1, np.int64), 0, pa.array([b"\n"], pa.large_binary()), np.array([np.count_nonzero(codes >= 0)]), np.zeros(1, np.int64))
    for start in range(0, len(codes), SHARD_WORDS):
        # Parts of a long run overlap, and report all they hold; what the next part counts is taken off.
        least = support if len(codes) <= SHARD_WORDS else 1
        yield from placed(codes[start : start + SHARD_WORDS + longest - 1], least, 1)
        yield from placed(codes[start + SHARD_WORDS :][: longest - 1], 1, -1)


def _rows(bucket: np.ndarray, size: int, lines: pa.Array, counts: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """A row for each start: the lines and counts from there to the next, cut out of their buffers."""
    cuts = np.append(starts, len(lines))
    ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :][cuts] if len(lines) else np.zeros(1, np.int64)

    def blobs(offsets: np.ndarray, data) -> pa.Array:
        offsets = pa.py_buffer(np.ascontiguousarray(offsets, np.int64))
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, data]).cast(pa.binary())

    columns = [pa.array(bucket), pa.array(np.full(len(starts), size, np.int32))]
    columns += [blobs(ends, lines.buffers()[2] or pa.py_buffer(b"")), blobs(8 * cuts, pa.py_buffer(counts.astype("<i8")))]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "words", "phrases", "counts"])


def reported(words: list[int], phrases: list[bytes], counts: list[bytes]) -> pa.Table:
    """(phrase, count, words) of rows that `shard_counts` gives."""
    parts = [pa.table({"phrase": pa.array([], pa.large_string()), "count": pa.array([], pa.int64()), "words": pa.array([], pa.int32())})]
    for size in sorted(set(words)):
        mine = [i for i, w in enumerate(words) if w == size]
        lines = pa.array([b"".join(phrases[i] for i in mine)], pa.large_binary())
        found = pc.split_pattern(lines, pattern=b"\n").flatten()[:-1].cast(pa.large_string())
        numbers = pa.array(np.frombuffer(b"".join(counts[i] for i in mine), "<i8"))
        parts.append(pa.table({"phrase": found, "count": numbers, "words": pa.repeat(pa.scalar(size, pa.int32()), len(found))}))
    return pa.concat_tables(parts)


def summed(rows: DataFrame, longest: int, support: int) -> DataFrame:
    """Phrases of (lang, total, open, text) with the sum of what the shards report. In an open language, of
    `total` bytes, the support is lowered to the share that the shard holds, and whatever a shard reports
    is kept; in others shards report everything, and what does not reach the support goes."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # lang: texts, their size, the language's size, whether it is open
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (texts, weight, total, open_) in held.items():
                local = max(1, -(-support * weight // total)) if open_ else 1
                for rows in shard_counts(texts, longest, local, -(-total // BUCKET_BYTES)):
                    same = [pa.repeat(pa.scalar(value), len(rows)) for value in (lang, open_)]
                    yield pa.RecordBatch.from_arrays([*same, *rows.columns], names=REPORT_NAMES)
            held.clear()

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_pylist()
            for lang, total, open_, text, n in zip(*(batch.column(i).to_pylist() for i in range(4)), sizes):
                mine = held.setdefault(lang, [[], 0, total, open_])
                mine[0].append(text)
                mine[1] += n + 1
                size += n + 1
                if size >= SHARD_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    def add_up(group: pa.Table) -> pa.Table:
        parts = reported(*(group.column(name).to_pylist() for name in ("words", "phrases", "counts")))
        total = parts.group_by(["words", "phrase"], use_threads=False).aggregate([("count", "sum")])
        if not group.column("open")[0].as_py():
            often = pc.greater_equal(total.column("count_sum"), support)
            total = total.filter(pc.or_(often, pc.equal(total.column("words"), 0)))
        lang = pa.repeat(group.column("lang")[0], len(total))
        phrases = total.column("phrase").cast(pa.string())
        return pa.table([lang, total.column("words"), phrases, total.column("count_sum")], names=NAMES)

    found = rows.select("lang", "total", "open", "text").mapInArrow(report, REPORT)
    return found.groupBy("lang", "bucket").applyInArrow(add_up, OUT)


# --- all shards ------------------------------------------------------------------------------


def _with_languages(rows: DataFrame, languages: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(languages) if few else languages, "lang")


def phrase_counts(
    docs: DataFrame, longest: int = 3, support: int = 10, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """(lang, words, phrase, count) of all phrases of up to `longest` words that occur at least
    `support` times in their language; with 0 words, the number of all words of each language."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UND)).alias("lang"), F.col(f"`{text}`").alias("text"))
    weight = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    by_task = rows.groupBy("lang", F.spark_partition_id().alias("task")).agg(F.sum(weight).alias("weight"))
    pieces = F.sum(F.ceil(F.col("weight") / SHARD_BYTES)).alias("shards")
    totals = by_task.groupBy("lang").agg(F.sum("weight").alias("total"), pieces)
    # With more shards a lowered support is hardly ever above one, and would save nothing.
    totals = stored(totals.withColumn("open", 2 * F.col("shards") <= support).drop("shards"), "languages")
    small = totals.count() <= MAX_LANGUAGES
    weighed = _with_languages(rows, totals, small)
    found = stored(summed(weighed, longest, support), "candidates")
    open_ = totals.where("open").select("lang")
    if open_.isEmpty():
        return found
    # A shard may have kept a candidate to itself: count all candidates of these languages in full.
    candidates = found.join(open_, "lang", "left_semi")
    every = summed(weighed.where("open").withColumn("open", F.lit(False)), longest, support)
    counted = every.join(candidates.select(*KEYS), KEYS, "left_semi")
    return found.join(open_, "lang", "left_anti").select(*NAMES).union(counted.select(*NAMES))


def _inside(phrase: Column, words: Column, shortest: int) -> Column:
    """All shorter phrases of at least `shortest` words within a phrase."""
    parts = F.split(phrase, " ")
    return F.flatten(
        F.transform(
            F.sequence(F.lit(shortest), words - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), words - size + 1), lambda at: F.array_join(F.slice(parts, at, size), " ")
            ),
        )
    )


def collocations(
    docs: DataFrame,
    longest: int = 3,
    support: int = 10,
    cover: int = 50,
    top: int = 2000,
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language: lang, rank (from 1), phrase, a (its
    occurrences, at least `support`), l and r (those of its parts at the cut with the lowest score), n
    (words of the language) and score floor(1000000 a a / (l r)).

    Texts are lower-cased (A-Z), cut at `.,;:!?` and line ends into pieces, and at blanks and tabs
    into words; phrases lie within pieces. Ties of cuts go to the shorter first part. A phrase is left out
    if it lies within a longer candidate that occurs at least `cover` per cent as often. Order: score, a,
    then the phrase by bytes. A null language is `und`; null and empty texts have no words; repeated
    rows count each. A language without candidates, and an empty table, give no row.
    """
    counts = stored(phrase_counts(docs, longest, support, lang, text), "phrases")
    candidates = counts.where("words > 1").withColumnRenamed("count", "a")
    longer = candidates.where("words > 2").select(
        "lang", F.explode(_inside(F.col("phrase"), F.col("words"), 2)).alias("phrase"), "a"
    )
    covers = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(covers, ["lang", "phrase"], "left")
    kept = kept.where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True))).drop("longer")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cut = cut.withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    parts = counts.where(f"words BETWEEN 1 AND {longest - 1}")
    cut = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("count").alias("l")), ["lang", "first"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r")), ["lang", "rest"])
    whole = "CAST({} AS DECIMAL(20, 0))".format
    score = F.expr(f"({SCALE} * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("least")
    scored = cut.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "least.l", "least.r", "least.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_k_per_group(scored, ["lang"], order, top)
    sizes = counts.where("words = 0").select("lang", F.col("count").alias("n"))
    best = _with_languages(best, sizes, sizes.count() <= MAX_LANGUAGES)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")
