"""Order-preserving packing by dynamic programming.

The documents of a partition, each with an end token, form one stream in their order. Windows of
the stream become sequences; where they may be cut is known (document ends, sentence ends, and
fixed steps inside sentences longer than a window), and the cuts that minimise padding plus
penalties for cut documents are found by dynamic programming. The padding of a window is linear in
its length, so the best predecessor is the minimum of a sliding window, kept in a monotone queue.
Windows whose length is a power of two need no padding; they are looked up by position.

Nothing is shuffled. A stream is solved in stretches; the last window of a stretch is handed on to
the next, so only the end of a partition leaves an unfilled sequence, and there any power of two is
allowed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.common import by_bytes, parts
from tallyvox.llm.units import spec, units

WINDOW = 2048
END_ID = 1
STRETCH = 1 << 18  # tokens solved at once
BATCH_CHARS = 1 << 22
SENTENCE_CUT = 8  # a cut at a sentence end costs as much as so many tokens of padding
WORD_CUT = 64  # a cut elsewhere
SHORT_SEQUENCE = 8  # a sequence of a lower power of two
LEAST_POWER = 8


def sequence_padding(length: int, window: int = WINDOW) -> int:
    """A sequence is padded to the window, except at a power of two."""
    return 0 if length & (length - 1) == 0 else window - length


def best_cuts(
    places: np.ndarray, penalty: np.ndarray, window: int = WINDOW, least_power: int = LEAST_POWER
) -> list[int]:
    """Indices into `places` (0 first, the end last, gaps of at most `window`) of the cheapest cuts.

    cost[j] = penalty[j] + min over i of cost[i] + padding(places[j] - places[i]): the minimum of
    cost[i] + places[i] over the window, or an exact power of two.
    """
    m = len(places)
    low = np.searchsorted(places, places - window, side="left").tolist()
    exact: dict[int, list[int]] = {}
    power = 1 << least_power
    while power < window:
        at = np.minimum(np.searchsorted(places, places - power), m - 1)
        for j in np.flatnonzero(places[at] == places - power).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        power *= 2
    place, costs = places.tolist(), penalty.tolist()
    total, before = [0.0] * m, [0] * m
    key = [0.0] * m  # total + place
    queue = deque([0])
    for j in range(1, m):
        lowest = low[j]
        while queue[0] < lowest:
            queue.popleft()
        i = queue[0]
        least = key[i] + window - place[j]
        for other in exact.get(j, ()):
            if total[other] + SHORT_SEQUENCE < least:
                i, least = other, total[other] + SHORT_SEQUENCE
        total[j], before[j] = least + costs[j], i
        mine = key[j] = total[j] + place[j]
        while queue and key[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    cuts, j = [m - 1], m - 1
    while j:
        j = before[j]
        cuts.append(j)
    return cuts[::-1]


class Stream:
    """The documents of one partition, packed in their order."""

    def __init__(self, ends: np.ndarray, window: int, first_sequence: int):
        self.ends, self.window, self.sequence = ends, window, first_sequence
        self.docs: list[tuple] = []  # id, ids still to be packed, ids before them, all ids
        self.size = 0

    def add(self, key, ids: np.ndarray) -> Iterator[list[tuple]]:
        self.docs.append((key, ids, 0, len(ids)))
        self.size += len(ids)
        if self.size >= STRETCH:
            yield self.solve(last=False)

    def _places(self, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the stream may be cut, at what cost, and where its documents end."""
        stream = np.concatenate([ids for _, ids, _, _ in self.docs])
        doc_ends = np.cumsum([len(ids) for _, ids, _, _ in self.docs])
        cost = np.full(len(stream) + 1, -1.0)
        cost[1:][self.ends[stream]] = SENTENCE_CUT
        cost[0] = cost[doc_ends] = 0
        if last:
            tails = len(stream) - (1 << np.arange(12))
            tails = tails[tails > 0]
            cost[tails] = np.where(cost[tails] < 0, WORD_CUT, cost[tails])
        known = np.flatnonzero(cost >= 0)
        wide = np.flatnonzero(np.diff(known) > self.window)
        for i in wide:
            inside = np.arange(known[i] + self.window // 8, known[i + 1], self.window // 8)
            cost[inside] = WORD_CUT
        places = np.flatnonzero(cost >= 0) if len(wide) else known
        return places, cost[places], doc_ends

    def solve(self, last: bool) -> list[tuple]:
        """The finished pieces; without `last`, the last window stays for the next stretch."""
        if not self.docs:
            return []
        places, cost, doc_ends = self._places(last)
        cuts = places[best_cuts(places, cost, self.window, 0 if last else LEAST_POWER)]
        done = int(cuts[-1] if last else cuts[-2])
        starts = np.concatenate([[0], doc_ends[:-1]])
        edges = np.unique(np.concatenate([cuts[cuts <= done], doc_ends[doc_ends < done], starts[starts < done]]))
        doc = np.searchsorted(doc_ends, edges[:-1], side="right").tolist()
        window = np.searchsorted(cuts, edges[:-1], side="right") - 1
        offset = (edges[:-1] - cuts[window]).tolist()
        rows = []
        for d, w, o, a, b in zip(doc, window.tolist(), offset, edges[:-1].tolist(), edges[1:].tolist()):
            key, ids, before, whole = self.docs[d]
            at = a - int(starts[d])
            rows.append((key, before + at, b - a, ids[at : at + b - a].tobytes(), whole, self.sequence + w, o))
        self.sequence += int(np.searchsorted(cuts, done))
        kept = int(np.searchsorted(doc_ends, done, side="right"))
        rest = self.docs[kept:]
        if rest:
            key, ids, before, whole = rest[0]
            at = done - int(starts[kept])
            rest[0] = (key, ids[at:], before + at, whole)
        self.docs, self.size = rest, int(doc_ends[-1]) - done
        return rows


@cache
def sentence_ends(path: str) -> np.ndarray:
    """For each id: does its token end a sentence?"""
    model, added = spec(path)["model"], spec(path)["added_tokens"]
    vocabulary = model["vocab"]
    ends = np.zeros(max([*vocabulary.values(), *(t["id"] for t in added), END_ID]) + 1, bool)
    suffix = model.get("end_of_word_suffix") or ""
    for token, number in vocabulary.items():
        ends[number] = token.endswith(tuple(mark + suffix for mark in ".!?"))
    return ends


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Pieces of documents in sequences of at most `window` ids: key, start (the document's ids
    before the piece), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset in the sequence.

    A document is the ids of its text by the tokenizer file at `path`, without special tokens,
    then the id 1; a null or empty text is just that id. Documents keep the order of their rows
    within a partition. Sequence ids are unique, and rise within a partition. Repeated rows are
    packed each on its own. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = (
        rows.select(F.col("id").alias(key)).schema.add("start", "long").add("length", "long")
        .add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    )
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = units(path, None)
        stream = Stream(sentence_ends(path), window, TaskContext.get().partitionId() << 36)
        kinds: list[pa.DataType] = [pa.null()]

        def table(found: list[tuple]) -> pa.RecordBatch:
            types = [kinds[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*found) if found else [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=schema.names
            )

        for batch in parts(batches):
            kinds[0] = batch.column(0).type
            keys, first = batch.column(0).to_pylist(), 0
            for texts in by_bytes((t or "" for t in batch.column(1).to_pylist()), BATCH_CHARS):
                for i, ids in enumerate(encode(texts)):
                    for found in stream.add(keys[first + i], np.append(ids, end)):
                        yield table(found)
                first += len(texts)
        if stream.docs:
            yield table(stream.solve(last=True))

    return rows.mapInArrow(run, schema)
