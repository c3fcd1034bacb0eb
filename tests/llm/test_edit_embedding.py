import hashlib
import random

import numpy as np

from tallyvox.llm import edit_embedding as ee
from tallyvox.llm.queries import LLM_QUERIES

NAMES = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]


def slow_print(text):
    """The walk, one step at a time."""
    n = len(text)
    if not n:
        return (0).to_bytes(8, "big")
    symbols = ee._symbols(np.array([ord(c) for c in text], np.uint32)).tolist()
    bits = ee._mix(np.arange(ee.PERIOD * ee.CLASSES, dtype=np.uint64)) & np.uint64(1)
    bits = bits.reshape(ee.PERIOD, ee.CLASSES)
    walk, at = [], 0
    for step in range(3 * n):
        walk.append(symbols[at] if at < n else 0)
        if at < n and bits[step % ee.PERIOD, symbols[at] % ee.CLASSES]:
            at += 1
    return n.to_bytes(8, "big") + bytes(walk[:: ee.stride(n)])


def test_fingerprints_are_the_walk():
    draw = random.Random(6)
    texts = ["", "a", "ab" * 40, "x" * 3000, "é😀" * 100]
    texts += ["".join(draw.choices("etaoin shrdlu.,É", k=draw.randrange(400))) for _ in range(60)]
    found = ee.fingerprints(texts)
    assert found == [slow_print(t) for t in texts]
    for i in (0, 3, 10):  # alone, in another order, in another company
        assert ee.fingerprints([texts[i]]) == [found[i]]
    assert ee.fingerprints(texts[::-1]) == found[::-1]


def test_walks_longer_than_the_period():
    texts = ["".join(random.Random(i).choices("abcdefgh ", k=70_000)) for i in range(14)]
    one, two = ee.fingerprints(texts), [ee.fingerprints([t])[0] for t in texts]
    assert one == two and one[0] == slow_print(texts[0])


def test_likeness_follows_the_edits():
    draw = random.Random(7)
    base = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=5000))
    other = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=5000))
    few = base[:1000] + "!" + base[1000:2500] + base[2503:]
    half = ee.edited(base, other)
    prints = ee.fingerprints([base, few, half, other])
    same, near, middle, far = (ee.likeness(prints[0], p) for p in prints)
    assert same == 1.0 and near > 0.8 and 0.4 < middle < 0.7 and far < 0.2
    assert ee.likeness(prints[0], prints[1]) == ee.likeness(prints[1], prints[0])
    empty = ee.fingerprints([""])[0]
    assert ee.likeness(empty, empty) == 1.0 and ee.likeness(empty, prints[0]) == 0.0
    assert ee.from_hex(prints[0].hex()) == prints[0]


def test_likeness_across_a_change_of_stride():
    text = "".join(random.Random(3).choices("abcdefghij ", k=700))
    sizes = [n for n in range(100, 700) if ee.stride(n) != ee.stride(n + 1)]
    for n in sizes:
        a, b = ee.fingerprints([text[:n], text[: n + 1]])
        assert len(a) != len(b) and ee.likeness(a, b) > 0.9
        assert set(ee.band_keys(a)) & set(ee.band_keys(b)) and ee.meet(a, b)


def slow_edited(text, following):
    """Code point by code point."""
    out = list(text)
    for _ in range(len(text) // 2):
        out.pop()
    for place, char in enumerate(following):
        if place < len(text) // 2:
            out.append(char)
    return "".join(out)


def slow_likeness(one, two):
    """Step by step, at the steps both know."""
    known = []
    for print_ in (one, two):
        size = ee.stride(int.from_bytes(print_[:8], "big"))
        known.append(({i * size: s for i, s in enumerate(print_[8:])}, size))
    (a, wide), (b, other) = known
    steps = [s for s in {*a, *b} if s % max(wide, other) == 0]
    seen = [(a.get(s, 0), b.get(s, 0)) for s in steps]
    seen = [pair for pair in seen if pair != (0, 0)]
    return sum(x == y for x, y in seen) / len(seen) if seen else 1.0


def test_likeness_and_edits_against_slow_forms(documents):
    texts = ["", "a", "ab", "é😀x", *[t or "" for _, t in documents[:150]]]
    prints = dict(zip(texts, ee.fingerprints(texts)))
    for t, f in zip(texts, [*texts[1:], texts[0]]):
        assert ee.edited(t, f) == slow_edited(t, f)
        assert abs(ee.likeness(prints[t], prints[f]) - slow_likeness(prints[t], prints[f])) < 1e-12


def test_meeting_is_a_shared_key(documents):
    draw = random.Random(9)
    for _, text in documents[:80]:
        text = text or ""
        cut = draw.randrange(len(text) + 1)
        for other in (text[:cut] + "#" + text[cut:], text[: cut // 2 + len(text) // 2], documents[0][1] or ""):
            a, b = ee.fingerprints([text, other])
            assert ee.meet(a, b) == bool(set(ee.band_keys(a)) & set(ee.band_keys(b)))


def test_near_links(spark):
    draw = random.Random(4)
    texts, wanted = [], set()
    for i in range(40):
        base = "".join(draw.choices("abcdefghijklmnop ", k=draw.randrange(300, 3000)))
        cut = draw.randrange(len(base))
        texts += [base, base[:cut] + "#" + base[cut:]]
        wanted.add((2 * i, 2 * i + 1))
    prints = ee.fingerprints(texts)
    table = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(prints)], "node long, print binary")
    found = {(r.a, r.b): r.likeness for r in ee.near_links(table).collect()}
    alike = {pair for pair in wanted if ee.likeness(prints[pair[0]], prints[pair[1]]) >= 0.8}
    assert set(found) <= wanted and len(set(found) & alike) >= 0.95 * len(alike) and len(alike) > 25


def brute(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r))
    out = []
    for (key, text), (_, following) in zip(rows, [*rows[1:], *rows[:1]]):
        changed = slow_edited(text, following)
        one, two, three = ee.fingerprints([text, changed, following])
        digest = hashlib.sha256(changed.encode()).hexdigest()
        near = (ee.likeness(one, two), ee.likeness(one, three))
        keys = [set(ee.band_keys(p)) for p in (one, two, three)]
        linked = (near[0] >= 0.8 and bool(keys[0] & keys[1]), near[1] >= 0.8 and bool(keys[0] & keys[2]))
        out.append((key, len(text), digest, *near, one.hex(), two.hex(), *linked))
    return sorted(out, key=repr)


def rows_of(frame):
    names = [*NAMES, "fingerprint", "edited_fingerprint", "linked_edited", "linked_next"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


def test_query(spark, sf_dir, documents):
    found = LLM_QUERIES["op8_edit_embedding"](spark, sf_dir)
    assert rows_of(found) == brute(documents)
    nearer = [r.near_edited > r.near_next for r in found.collect()]
    assert np.mean(nearer) > 0.99


def test_small_groups_and_few_partitions(spark, monkeypatch, documents):
    docs = spark.createDataFrame(documents[:30], "doc_id long, text string")
    assert rows_of(ee.compare_successors(docs)) == brute(documents[:30])
    one = spark.createDataFrame([(7, "single text")], "doc_id long, text string")
    assert rows_of(ee.compare_successors(one)) == brute([(7, "single text")])


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert rows_of(ee.compare_successors(odd_documents)) == brute(rows)
    assert ee.compare_successors(no_documents).count() == 0
