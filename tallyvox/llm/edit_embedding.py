"""Document fingerprints by a randomised edit embedding.

All texts share one random walk (Chakraborty, Goldenberg, Koucky, 2016): at step j the walk stands
on a character and moves on if a shared random bit for (j, character) is one. What it stands on at
the steps 0 to 3n is the embedded text. Texts a few edits apart fall into step again after each
edit, so edit distance becomes Hamming distance.

The fingerprint samples the embedding at the multiples of a power of two, between 64 and 128 of
them; the samples of a longer stride are among those of a shorter one, so texts of different
length compare at their common steps. Likeness is the share of equal samples. Bands of samples
find candidates, which are then verified by their likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyvox.llm.common import parts, shuffle_partitions, stored

SEED = 11
CLASSES = 64  # characters fall into so many classes; each has its own random bits
PERIOD = 1 << 16  # steps after which the bits repeat
SAMPLES = 128
GROUP_CHARS = 6 << 20
FEW = 12  # so few walks are quicker one by one
BANDS, BAND_SAMPLES = 16, 4
BAND_PLACES = SAMPLES // 4  # of the first samples at a stride
LINKED = 0.8  # likeness of linked texts
HEADER = 8  # bytes of the length before the samples


# --- the walk --------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A seeded 64-bit hash of whole numbers."""
    x = (x + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _steps() -> tuple[np.ndarray, bytes]:
    """How long the walk stays on a character of class c from step j on, at [j * CLASSES + c]:
    until the first one among its bits, which repeat after PERIOD steps."""
    stay = np.empty((PERIOD, CLASSES), np.uint8)
    step = np.arange(2 * PERIOD)
    for kind in range(CLASSES):
        bits = _mix(np.arange(PERIOD, dtype=np.uint64) * np.uint64(CLASSES) + np.uint64(kind)) & np.uint64(1)
        ones = np.where(np.tile(bits, 2) > 0, step, 2 * PERIOD)
        following = np.minimum.accumulate(ones[::-1])[::-1]
        stay[:, kind] = np.minimum(following[:PERIOD] - step[:PERIOD] + 1, 255)
    return stay.reshape(-1), stay.tobytes()


@cache
def _symbol_table() -> np.ndarray:
    """A byte from 1 to 255 for each code point; its low bits are the class. 0 is for no character."""
    blocks = np.arange(0x110000, dtype=np.uint64).reshape(17, -1)
    return np.concatenate([(1 + _mix(block) % np.uint64(255)).astype(np.uint8) for block in blocks])


def _symbols(codes: np.ndarray) -> np.ndarray:
    return _symbol_table()[codes]


def arrivals(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, symbols, steps): for all characters of all texts in a row, the symbol and the step
    at which the walk reaches it. Texts walk side by side, the longest first."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = _symbols(codes)
    del codes
    kinds = symbols & (CLASSES - 1)
    # Walks have about two steps for each character.
    reached = np.empty(len(symbols), np.int32 if sizes.max(initial=0) < 1 << 28 else np.int64)
    stay, stay_bytes = _steps()
    order = np.argsort(-sizes, kind="stable")
    cursor, sorted_sizes = starts[order].copy(), sizes[order]
    step = np.zeros(len(texts), np.int64)
    # How many texts have a character at place i: looked up once for each distinct count.
    place, active = 0, int(np.count_nonzero(sizes))
    while active > FEW:
        until = int(sorted_sizes[active - 1])
        at, now = cursor[:active], step[:active]
        for _ in range(place, until):
            reached[at] = now
            now += stay[((now & (PERIOD - 1)) * CLASSES) + kinds[at]]
            at += 1
        place = until
        active = int(np.searchsorted(-sorted_sizes, -place, side="left"))
    mask = PERIOD - 1
    for lane in range(active):
        first, last, now = int(cursor[lane]), int(starts[order[lane] + 1]), int(step[lane])
        for block in range(first, last, 1 << 16):  # bounded lists for very long texts
            end, seen = min(last, block + (1 << 16)), []
            for kind in kinds[block:end].tolist():
                seen.append(now)
                now += stay_bytes[(now & mask) * CLASSES + kind]
            reached[block:end] = seen
    return starts, symbols, reached


def stride(chars: int) -> int:
    """The power of two that leaves at most SAMPLES of the 3n steps."""
    size = 1
    while -(-3 * chars // size) > SAMPLES:
        size *= 2
    return size


def fingerprints(texts: list[str]) -> list[bytes]:
    """The length in code points, then the samples. Equal texts have equal fingerprints."""
    starts, symbols, reached = arrivals(texts)
    found = []
    for i, text in enumerate(texts):
        n = len(text)
        a, b = int(starts[i]), int(starts[i + 1])
        asked = np.arange(0, 3 * n, stride(n))
        standing = np.searchsorted(reached[a:b], asked, side="right") - 1
        taken = symbols[a:b][standing] if n else np.empty(0, np.uint8)
        if n:  # after its last character the walk stands on nothing
            last = int(reached[b - 1])
            left = last + int(_steps()[0][(last & (PERIOD - 1)) * CLASSES + int(symbols[b - 1] & (CLASSES - 1))])
            taken = np.where(asked < left, taken, 0).astype(np.uint8)
        found.append(n.to_bytes(HEADER, "big") + taken.tobytes())
    return found


def likeness(one: bytes, two: bytes) -> float:
    """Share of equal samples among the steps that both fingerprints know and where at least one
    walk stands on a character; two empty texts are alike."""
    n, m = (int.from_bytes(x[:HEADER], "big") for x in (one, two))
    a, b = (np.frombuffer(x, np.uint8, offset=HEADER) for x in (one, two))
    wide = max(stride(n), stride(m))
    a, b = a[:: wide // stride(n)], b[:: wide // stride(m)]
    size = max(len(a), len(b))
    a, b = (np.pad(x, (0, size - len(x))) for x in (a, b))
    some = (a > 0) | (b > 0)
    return float((a == b)[some].mean()) if some.any() else 1.0


def from_hex(text: str) -> bytes:
    return bytes.fromhex(text)


# --- near documents --------------------------------------------------------------------------


@cache
def _places() -> np.ndarray:
    """The samples of each band."""
    drawn = _mix(np.arange(BANDS * BAND_SAMPLES, dtype=np.uint64) + np.uint64(1 << 40))
    return (drawn % np.uint64(BAND_PLACES)).astype(np.int64).reshape(BANDS, BAND_SAMPLES)


def _bands(print_: bytes) -> dict[int, np.ndarray]:
    """The bands of one fingerprint at its own stride and at the next longer one, so that texts on
    both sides of a change of stride meet."""
    wide = stride(int.from_bytes(print_[:HEADER], "big"))
    samples, found = np.frombuffer(print_, np.uint8, offset=HEADER), {}
    for step in (1, 2):
        level = samples[::step]
        level = level[level > 0][:BAND_PLACES]  # the walk has an end, so only its samples count
        padded = np.zeros(BAND_PLACES, np.uint8)
        padded[: len(level)] = level
        found[wide * step] = padded[_places()]
    return found


def band_keys(print_: bytes) -> list[int]:
    keys = set()
    for wide, bands in _bands(print_).items():
        for band, taken in enumerate(bands.tolist()):
            text = f"{wide}:{band}:{taken}".encode()
            keys.add(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True))
    return sorted(keys)


def meet(one: bytes, two: bytes) -> bool:
    """Whether two fingerprints share a band, and so a key."""
    a, b = _bands(one), _bands(two)
    return any((a[wide] == b[wide]).all(axis=1).any() for wide in a.keys() & b.keys())


def near_links(prints: DataFrame, threshold: float = LINKED) -> DataFrame:
    """(a, b, likeness) of nodes whose fingerprints share a band and are at least `threshold`
    alike; `prints` has node (long) and print (binary), one row for each distinct print."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [band_keys(p) for p in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(k) for k in found])
            flat = pa.array([k for ks in found for k in ks], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [flat, batch.column(0).take(at), batch.column(1).take(at)], names=["key", "node", "print"]
            )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            alike = pa.array([likeness(p, q) for p, q in zip(x, y)], pa.float64())
            whole = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), alike], names=["a", "b", "likeness"]
            )
            yield whole.filter(pa.compute.greater_equal(alike, threshold))

    banded = stored(
        prints.select("node", "print").mapInArrow(keys, "key long, node long, print binary"), "bands"
    )
    left = banded.select("key", F.col("node").alias("a"), F.col("print").alias("x"))
    right = banded.select("key", F.col("node").alias("b"), F.col("print").alias("y"))
    pairs = left.join(right, "key").where("a < b").select("a", "b", "x", "y").dropDuplicates(["a", "b"])
    return pairs.mapInArrow(verify, "a long, b long, likeness double")


# --- documents and their successors ----------------------------------------------------------


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(keys: list, texts: list[str], following: list[str]) -> list[tuple]:
    """The result rows of some documents, given the text that follows each."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    known = dict.fromkeys([*texts, *following, *changed])
    known = dict(zip(known, fingerprints(list(known))))
    rows = []
    for key, t, f, c in zip(keys, texts, following, changed):
        mine, its, next_ = known[t], known[c], known[f]
        alike, after = likeness(mine, its), likeness(mine, next_)
        linked = (alike >= LINKED and meet(mine, its), after >= LINKED and meet(mine, next_))
        rows.append((key, len(t), hashlib.sha256(c.encode("utf-8")).hexdigest(), mine, its, alike, after, *linked))
    return rows


FIELDS = [
    ("n_chars", "long", pa.int64()),
    ("edited_sha256", "string", pa.string()),
    ("print", "binary", pa.binary()),
    ("edited_print", "binary", pa.binary()),
    ("near_edited", "double", pa.float64()),
    ("near_next", "double", pa.float64()),
    ("linked_edited", "boolean", pa.bool_()),
    ("linked_next", "boolean", pa.bool_()),
]


def compare_successors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex),
    near_edited and near_next, linked_edited and linked_next (they share a band, and the check of
    their likeness gives at least LINKED).

    Each text (null: empty) is compared with its edited text and with the next document in order of
    the key (of equal keys, of the text); after the last comes the first. A single document follows
    itself. Texts are range-partitioned by key and meet their successors in a stream; only the
    first and last document of each partition are joined. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    schema = rows.select("id").schema
    for name, kind, _ in FIELDS:
        schema = schema.add(name, kind)
    piece = StructType(list(schema.fields))
    for name, kind in (("part", "long"), ("place", "string"), ("text", "string")):
        piece = piece.add(name, kind)

    def batch_of(found: list[tuple], kind: pa.DataType, more: tuple = ()) -> pa.RecordBatch:
        types = [kind, *(t for _, _, t in FIELDS), *more]
        names = piece.names[: len(types)]
        columns = zip(*found) if found else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kind = TaskContext.get().partitionId(), pa.null()
        more = (pa.int64(), pa.string(), pa.string())
        keys, texts, size, begun = [], [], 0, False
        blank = (None,) * len(FIELDS)

        def solved() -> list[tuple]:
            return [r + (part, "inner", None) for r in _compared(keys[:-1], texts[:-1], texts[1:])]

        for batch in parts(batches):
            kind = batch.column(0).type
            for id_, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not begun:
                    begun = True
                    yield batch_of([(id_, *blank, part, "first", body)], kind, more)
                keys.append(id_)
                texts.append(body)
                size += len(body)
                if size >= GROUP_CHARS and len(keys) > 1:
                    yield batch_of(solved(), kind, more)
                    keys, texts, size = keys[-1:], texts[-1:], len(texts[-1])
        if keys:
            yield batch_of([*solved(), (keys[-1], *blank, part, "last", texts[-1])], kind, more)

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, following = (batch.column(i).to_pylist() for i in range(3))
            for i in range(0, len(keys), 64):
                found = _compared(keys[i : i + 64], texts[i : i + 64], following[i : i + 64])
                yield batch_of(found, batch.column(0).type)

    pieces = stored(
        rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "id")
        .sortWithinPartitions("id", "text")
        .mapInArrow(run, piece),
        "successors",
    )
    # One row for each partition that has a document.
    order = Window.orderBy("part")
    following = pieces.where("place = 'first'").select("part").withColumn(
        "next", F.coalesce(F.lead("part").over(order), F.first("part").over(order))
    )
    firsts = pieces.where("place = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = (
        pieces.where("place = 'last'")
        .select("part", "id", "text")
        .join(following, "part")
        .join(firsts, "next")
        .select("id", "text", "following")
        .mapInArrow(join_ends, schema)
    )
    inner = pieces.where("place = 'inner'").select(*schema.names)
    return inner.unionByName(ends).select(
        F.col("id").alias(key),
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "linked_edited",
        "linked_next",
    )
