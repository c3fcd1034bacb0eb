"""URL rules behind a blocked Bloom filter.

The list of canonical rules (host and path prefix) becomes a table of 256-bit blocks, one row per
block. A URL asks for every host suffix and path prefix it has; questions whose four bits are all
set in their block are possible hits, and an exact hash join with the list removes the false ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.operators.lookup import inline_frame

BITS_PER_RULE = 16
BLOCK_BITS = 256
WORDS = BLOCK_BITS // 64
PROBES = 4
LEAST_BLOCKS = 1024  # few rules still spread over many blocks
BROADCAST_ROWS = 500_000  # of 5 longs: 20 MB; larger filters and lists are joined by shuffle

RULE_SCHEMA = "rule_host string, rule_path string, action string"
MAX_INLINE = 1000  # rules


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from
    there up to `?`, `#` or the end. Null, or no `://`: both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """`(action, "host/path")` pairs as a rule table: up to MAX_INLINE of them as constants of the plan."""
    rows = []
    for action, rule in rules:
        host, slash, path = rule.partition("/")
        rows.append((host.lower(), slash + path, action))
    if 0 < len(rows) <= MAX_INLINE:
        return inline_frame(spark, rows, ["rule_host", "rule_path", "action"])
    return spark.createDataFrame(rows, RULE_SCHEMA)


def canonical(rules: DataFrame) -> DataFrame:
    """One row per host and path: a rule listed twice with both actions blocks."""
    return (
        rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND action IS NOT NULL")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"))
    )


def _hash(host: str, path: str) -> Column:
    return F.xxhash64(F.col(host), F.col(path))


def _block(blocks: int) -> Column:
    return F.pmod(F.col("hash"), F.lit(blocks))


def _probe(i: int) -> Column:
    """The i-th bit number in a block, from bits of a second hash."""
    again = F.xxhash64(F.col("hash"), F.lit(17))
    return F.shiftrightunsigned(again, 16 * i).bitwiseAND(F.lit(BLOCK_BITS - 1))


def _word(w: int) -> Column:
    """The bits of the four probes that fall into word w of the block."""
    word = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.expr("1L").alias("one")
        mine = F.shiftrightunsigned(_probe(i), 6) == w
        shift = _probe(i).bitwiseAND(F.lit(63)).cast("int")
        word = word.bitwiseOR(
            F.when(mine, F.call_function("shiftleft", bit, shift)).otherwise(F.lit(0).cast("long"))
        )
    return word


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """The filter: block, w0 to w3. Blocks without a rule have no row."""
    hashed = rules.select(_hash("rule_host", "rule_path").alias("hash"))
    words = hashed.select(_block(blocks).alias("block"), *[_word(w).alias(f"w{w}") for w in range(WORDS)])
    return words.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def _numbers(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(n) for n in sorted(values)]).cast("array<int>")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    otherwise: str = "allow",
) -> DataFrame:
    """One row per page: key, host, path, rule (`host` + `path` of the longest that fits, or null)
    and verdict (the rule's action; `otherwise` where none fits).

    A rule fits its host and all subdomains if the page's path starts with the rule's path. The
    longest rule wins by the length of host and path together; of equal lengths, the longer host. Repeated pages and
    URLs each get their row; a null URL has an empty host and path, which no rule fits. An empty
    table gives an empty result; an empty list judges every page by `otherwise`.
    """
    rules = canonical(rules)
    count = rules.count()
    small = count <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda frame: frame)
    host, path = host_and_path(F.col(f"`{url}`"))
    asked = pages.select(F.col(f"`{key}`").alias("id"), host.alias("host"), path.alias("path"))

    # Only host suffixes with as many labels, and path prefixes as long, as some rule has can be
    # listed. Both lists are short: distinct lengths of the rules, not rules.
    shapes = rules.agg(
        F.collect_set(F.size(F.split("rule_host", "\\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("sizes"),
    ).first()
    labels = F.split("host", "\\.")
    counts = F.filter(_numbers(shapes.labels), lambda n: n <= F.size(labels))
    suffixes = F.transform(
        counts, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    )
    prefixes = F.filter(_numbers(shapes.sizes), lambda n: n <= F.length("path"))
    # Every distinct host and path once: a third of all pages may share one URL.
    questions = (
        asked.where("host <> ''")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("rule_host"))
        .select("host", "path", "rule_host", F.explode(prefixes).alias("size"))
        .select("host", "path", "rule_host", F.substr("path", F.lit(1), F.col("size")).alias("rule_path"))
        .withColumn("hash", _hash("rule_host", "rule_path"))
    )
    blocks = max(LEAST_BLOCKS, -(-count * BITS_PER_RULE // BLOCK_BITS))
    bloom = bloom_blocks(rules, blocks)
    wanted = [_word(w) for w in range(WORDS)]
    possible = questions.withColumn("block", _block(blocks)).join(hint(bloom), "block")
    for w in range(WORDS):
        possible = possible.where(F.col(f"w{w}").bitwiseAND(wanted[w]) == wanted[w])
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("long"),
        F.length("rule_host").alias("host_long"),
    )
    hits = (
        possible.select("host", "path", "rule_host", "rule_path")
        .join(hint(rules), ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(rank, F.concat("rule_host", "rule_path").alias("rule"), F.col("action"))
            ).alias("best")
        )
        .select("host", "path", "best.rule", "best.action")
    )
    return asked.join(hits, ["host", "path"], "left").select(
        F.col("id").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("action", F.lit(otherwise)).alias("verdict"),
    )
