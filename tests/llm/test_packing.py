import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyvox.llm import packing
from tallyvox.llm.common import tokenizer_path
from tallyvox.llm.queries import LLM_QUERIES

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(rows, wanted):
    """`rows`: doc, start, length, crc, doc_tokens, sequence, offset. Returns (padding, tokens)."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, whole, sequence, offset in rows:
        pieces[doc].append((start, length, crc, whole))
        sequences[sequence].append((offset, length))
    assert set(pieces) == set(wanted)
    for doc, parts in pieces.items():
        ids, at = wanted[doc], 0
        for start, length, crc, whole in sorted(parts):
            assert start == at and length > 0 and whole == len(ids)
            assert crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padding += packing.sequence_padding(at)
    return padding, sum(map(len, wanted.values()))


def test_query(spark, sf_dir, documents, encode):
    found = LLM_QUERIES["op6_packing"](spark, sf_dir)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = [tuple(r) for r in found.select(*names).collect()]
    padding, tokens = check(rows, {key: encode(text) for key, text in documents})
    assert padding < 0.02 * tokens


def brute_cost(places, penalty, window, least_power):
    best = [0.0]
    for j in range(1, len(places)):
        costs = []
        for i in range(j):
            size = places[j] - places[i]
            if size <= window:
                costs.append(best[i] + window - size)
                if size < window and size & (size - 1) == 0 and size >= 1 << least_power:
                    costs.append(best[i] + packing.SHORT_SEQUENCE)
        best.append(min(costs) + penalty[j])
    return best[-1]


def cost_of(cuts, places, penalty, window, least_power):
    total = 0.0
    for i, j in zip(cuts, cuts[1:]):
        size = places[j] - places[i]
        assert 0 < size <= window
        padding = window - size
        if size < window and size & (size - 1) == 0 and size >= 1 << least_power:
            padding = min(padding, packing.SHORT_SEQUENCE)
        total += padding + penalty[j]
    return total


def test_cuts_are_the_cheapest():
    draw = random.Random(9)
    for _ in range(300):
        window, power = draw.choice([(16, 2), (64, 3), (128, 4), (64, 0)])
        steps = [draw.randrange(1, draw.choice([4, window // 2, window + 1])) for _ in range(draw.randrange(1, 40))]
        places = np.cumsum([0, *steps])
        penalty = np.array([0, *(draw.choice([0, 8, 64]) for _ in steps)], float)
        cuts = packing.best_cuts(places, penalty, window, power)
        assert cuts[0] == 0 and cuts[-1] == len(steps)
        mine = cost_of(cuts, places, penalty, window, power)
        assert mine == brute_cost(places, penalty, window, power)


def test_long_streams_hand_on_their_last_window(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 5000)
    draw = np.random.default_rng(4)
    ends = np.zeros(1000, bool)
    ends[[5, 6]] = True
    stream, rows, wanted, order = packing.Stream(ends, packing.WINDOW, 100), [], {}, []
    for key in range(120):
        size = int(draw.choice([1, 3, 40, 700, 9000]))
        top = 400 if key % 10 == 0 else 30  # some without sentence ends for long
        ids = draw.integers(7 if key % 10 == 0 else 2, top, size).astype("<u4")
        ids[-1] = 1
        wanted[key] = ids
        for found in stream.add(key, ids):
            rows += found
    rows += stream.solve(last=True)
    rows = [(k, s, n, zlib.crc32(b), w, q, o) for k, s, n, b, w, q, o in rows]
    padding, tokens = check(rows, wanted)
    assert padding < 0.03 * tokens
    order = [(r[5], r[6]) for r in sorted(rows, key=lambda r: (r[0], r[1]))]
    assert order == sorted(order)  # documents keep their order
    assert sorted({r[5] for r in rows}) == list(range(100, 100 + len({r[5] for r in rows})))


def test_documents_are_cut_at_sentences_where_that_costs_little(spark, encode):
    docs = spark.createDataFrame([(1, "One two three four five six seven. " * 2000)], "doc_id long, text string")
    rows = packing.pack(docs.coalesce(1), PATH).orderBy("start").collect()
    stop = int(encode(".")[0])
    for row in rows[:-3]:
        assert np.frombuffer(row.ids, "<u4")[-1] == stop
        assert row.length > 2040 or packing.sequence_padding(row.length) == 0


def test_odd_rows(spark, odd_documents, no_documents, encode):
    numbered = spark.createDataFrame(
        [(i, r.text, 0) for i, r in enumerate(odd_documents.collect())], "doc_id long, text string, start int"
    )
    rows = [(r.doc_id, r.start, r.length, zlib.crc32(r.ids), *r[4:]) for r in packing.pack(numbered, PATH).collect()]
    check(rows, {r.doc_id: encode(r.text) for r in numbered.collect()})
    repeated = packing.pack(odd_documents, PATH).where("doc_id = 5").collect()
    assert sum(r.length for r in repeated) == 3 * len(encode("same text here"))
    assert packing.pack(no_documents, PATH).count() == 0
