"""Connected components of a link table.

Alternating large-star and small-star steps: every node links its larger neighbours, then its
smaller ones, to the smallest node it sees. Each round is two grouped minima and two joins over the
links, which never become more; the number of rounds grows with the logarithm of the longest
chain. Links are written after each round; nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.common import stored

MAX_ROUNDS = 100


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a"))


def _large_star(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: for every node, its larger neighbours go to its smallest neighbour."""
    ways = _both_ways(edges).toDF("u", "v")
    least = ways.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return ways.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """For every node, its smaller neighbours and itself go to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a > m").select(F.col("m"), F.col("a"))
    return moved.toDF("a", "b").union(least.select(F.col("m").alias("a"), "b"))


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(mixed, F.lit(1 << 31))), F.bit_xor(mixed)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (a, b), a < b: the smallest node reachable.
    Repeated links count once. No links, no rows."""
    edges = stored(edges.distinct(), "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "links")
        state, before = _state(edges), state
        if state == before:
            break
    else:
        raise RuntimeError("the links did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
