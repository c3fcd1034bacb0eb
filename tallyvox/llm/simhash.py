"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code is perfect:
every 23-bit word is within three bits of exactly one codeword. Decoding a segment, and decoding
it with each of its bits flipped, gives the codewords near it: one or six. If two segments differ
in at most one bit, the plain codeword of one is among the codewords near the other.

Three differing bits fall on the segments so that either some segment is untouched, and then one
of the other two has at most one, or each has exactly one. So seven keys cover all cases: a whole
segment with the codeword of another (six ordered pairs), and the codewords of all three. Keys are
joined, and only pairs that truly differ in at most three bits are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.common import as_row, stored
from tallyvox.llm.components import components

# The generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1,
# and the seed of the shingle hash.
GOLAY = 0b110001110101
SEED = 42

DISTANCE = 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
NO_KEY = (1 << 63) - 1  # stands for a null key
BLOCK = 1 << 15  # shingles at a time, so that a very long text needs no more memory


# --- fingerprints ----------------------------------------------------------------------------


def fingerprint(text: str | None, size: int = 3) -> int:
    """The unsigned SimHash of a text: words are runs without ASCII white space, A-Z lower-cased;
    shingles of `size` words, repeats included; fewer words are one shingle, none gives zero. A
    bit is set if it is set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    total, ones = len(words) - size + 1, np.zeros(64, np.int64)
    for first in range(0, total, BLOCK):
        part = words[first : first + BLOCK + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size))))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """Every row as (row, bits): the whole input row and its fingerprint as a signed long."""

    @F.arrow_udf("long")
    def bits(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([_signed(fingerprint(t.as_py(), size)) for t in column], pa.int64())

    # Only the text goes to the worker and only the fingerprint comes back.
    return docs.select(as_row(docs), bits(F.col(f"`{text}`")).alias("bits"))


def as_hex(bits) -> F.Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


# --- Golay code ------------------------------------------------------------------------------


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of each 12-bit message, and the message part of the error of each syndrome."""

    def check(word: int) -> int:  # remainder modulo the generator
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    checks = np.array([check(message << 11) for message in range(1 << 12)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    flips = [1 << i for i in range(23)]
    for a in range(23):
        for b in range(a + 1):
            for c in range(b + 1):  # repeated bits give the errors of fewer than three bits
                error = flips[a] | flips[b] | flips[c]
                errors[checks[error >> 11] ^ (error & 0x7FF)] = error >> 11
    return checks, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit message of the codeword nearest to each 23-bit word."""
    checks, errors = _tables()
    message = words >> 11
    return message ^ errors[checks[message] ^ (words & 0x7FF)]


def near(words: np.ndarray, bits: int) -> list[np.ndarray]:
    """Messages of the codewords near each word: that of the word and those of its neighbours,
    each once per word (a repeat is -1)."""
    found = [decode(words)]
    for bit in range(bits):
        found.append(decode(words ^ (1 << bit)))
    table = np.sort(np.stack(found, axis=1), axis=1)
    table[:, 1:][table[:, 1:] == table[:, :-1]] = -1
    return list(table.T)


def _keys(values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(side, positions, keys): side 0 is looked up by side 1. A key names its case in the bits
    above 40."""
    parts = [(values >> first) & ((1 << bits) - 1) for first, bits in SEGMENTS]
    plain = [decode(part) for part in parts]
    around = [near(part, bits) for part, (_, bits) in zip(parts, SEGMENTS)]
    everyone = np.arange(len(values))
    for case, (whole, fuzzy) in enumerate(permutations(range(3), 2)):
        base = (case << 40) | (parts[whole] << 12)
        yield 0, everyone, base | plain[fuzzy]
        for code in around[fuzzy]:
            hit = np.flatnonzero(code >= 0)
            if len(hit):
                yield 1, hit, base[hit] | code[hit]
    base = 6 << 40
    for code in around[0]:
        hit = np.flatnonzero(code >= 0)
        if len(hit):
            yield 0, hit, base | (code[hit] << 24) | (plain[1][hit] << 12) | plain[2][hit]
    for b, c in product(around[1], around[2]):
        hit = np.flatnonzero((b >= 0) & (c >= 0))
        if len(hit):
            yield 1, hit, base | (plain[0][hit] << 24) | (b[hit] << 12) | c[hit]


def golay_keys(nodes: DataFrame) -> DataFrame:
    """(side, key, node, bits) for every key of every (node, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for side, at, keys in _keys(bits.view(np.uint64).astype(np.uint64).view(np.int64)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), side, np.int8)),
                        pa.array(keys),
                        pa.array(node[at]),
                        pa.array(bits[at]),
                    ],
                    names=["side", "key", "node", "bits"],
                )

    return nodes.select("node", "bits").mapInArrow(run, "side byte, key long, node long, bits long")


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of nodes whose bits differ in at most `distance` places. Each node has
    its own bits. Repeats of a pair are left to the reader."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the keys cover up to three differing bits")
    keys = stored(golay_keys(nodes), "golay-keys")
    left = keys.where("side = 0").select("key", F.col("node").alias("a"), F.col("bits").alias("x"))
    right = keys.where("side = 1").select("key", F.col("node").alias("b"), F.col("bits").alias("y"))
    differing = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return left.join(right, "key").where((F.col("a") < F.col("b")) & (differing <= distance)).select("a", "b")


# --- groups ----------------------------------------------------------------------------------


def group(prints: DataFrame, key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(bits, node, component, first): for each distinct fingerprint in `prints` (row, bits), its
    smallest key, the smallest key in its component and whether it is the fingerprint that stays:
    of those with that key, the smallest. The graph's nodes are the fingerprints, so equal ones
    add no link, and fingerprints that share a key, or have none, stay apart. Null keys take part
    as a key above all others."""
    id_ = F.coalesce(F.col(f"row.`{key}`").cast("long"), F.lit(NO_KEY))
    nodes = stored(prints.groupBy("bits").agg(F.min(id_).alias("node")).select("node", "bits"), "nodes")
    found = components(links(nodes.select(F.col("bits").alias("node"), "bits"), distance))
    labelled = nodes.join(found.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "node", F.coalesce("component", "bits").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min(F.struct("node", "bits")).alias("least"))
    return labelled.join(least, "label").select(
        "bits",
        "node",
        F.col("least.node").alias("component"),
        (F.col("least.bits") == F.col("bits")).alias("first"),
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id (the smallest key
    that links reach; null if they reach none).

    Null and empty texts have the fingerprint zero, which links like any other. Repeated rows and
    equal texts share a component. The key is an integer, unique among different texts. An empty
    table gives an empty result.
    """
    prints = stored(fingerprints(docs.select(f"`{key}`", f"`{text}`"), text), "simhash")
    groups = group(prints, key).drop("node")
    return prints.join(groups, "bits").select(
        F.col(f"row.`{key}`").alias(key),
        as_hex(F.col("bits")).alias("fingerprint"),
        F.nullif("component", F.lit(NO_KEY)).alias("component_id"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose key is the smallest of their component, with the columns of the input. Where
    several rows carry that key, those with the smallest fingerprint stay."""
    prints = stored(fingerprints(docs, text), "simhash")
    id_ = F.coalesce(F.col(f"row.`{key}`").cast("long"), F.lit(NO_KEY))
    first = group(prints, key).where("first").select("bits", "node")
    return (
        prints.withColumn("node", id_).join(first, ["bits", "node"], "left_semi").select("row.*")
    )
