import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyvox.llm import simhash
from tallyvox.llm.components import components
from tallyvox.llm.queries import LLM_QUERIES


def brute_print(text):
    lowered = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: {id: bits}."""
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bits = np.array([prints[i] for i in ids], np.uint64)
    for a, one in zip(ids, bits):
        for b in np.flatnonzero(np.bitwise_count(bits ^ one) <= 3):
            x, y = root(a), root(ids[b])
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_query(spark, sf_dir, documents):
    found = {r.doc_id: r for r in LLM_QUERIES["op7_simhash"](spark, sf_dir).collect()}
    prints = {key: brute_print(text) for key, text in documents}
    groups = brute_components(prints)
    assert len(found) == len(documents)
    for key in prints:
        assert found[key].fingerprint == f"{prints[key]:016x}"
        assert found[key].component_id == groups[key]


def test_golay_code_is_perfect():
    checks, errors = simhash._tables()
    words = np.arange(1 << 23)
    codewords = (simhash.decode(words) << 11) | checks[simhash.decode(words)]
    apart = np.bitwise_count(words ^ codewords)
    assert apart.max() == 3 and np.bincount(apart).tolist() == [4096 * n for n in (1, 23, 253, 1771)]
    codes = np.sort((np.arange(4096) << 11) | checks)
    assert np.unique(np.bitwise_count(codes)).tolist() == [0, 7, 8, 11, 12, 15, 16, 23]


def shared_key(a, b):
    keys = [[set(), set()] for _ in range(2)]
    for side, at, key in simhash._keys(np.array([a, b], np.uint64).view(np.int64)):
        for who, k in zip(at.tolist(), key.tolist()):
            keys[who][side].add(k)
    return bool(keys[0][0] & keys[1][1]), bool(keys[1][0] & keys[0][1])


def test_any_three_bits_leave_a_shared_key():
    draw = random.Random(8)
    for _ in range(250):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randrange(1, 4)):
            b ^= 1 << bit
        assert shared_key(a, b) == (True, True)  # whichever of the two has the smaller id
    for split in ([0, 23, 46], [22, 45, 63], [0, 1, 2], [46, 47, 48], [5, 30, 31]):
        b = sum(1 << bit for bit in split)
        assert shared_key(0, b) == (True, True)


def test_links_of_random_and_crowded_fingerprints(spark):
    """Chains and crowds around a few centres: every link is found, no other."""
    draw = random.Random(12)
    bits = {draw.getrandbits(64) for _ in range(300)}
    for centre in list(bits)[:5]:
        for _ in range(60):
            near = centre
            for bit in draw.sample(range(64), draw.randrange(1, 6)):
                near ^= 1 << bit
            bits.add(near)
    nodes = [(i, simhash._signed(b)) for i, b in enumerate(sorted(bits, key=hash))]
    values = np.array([b for _, b in nodes]).view(np.uint64)
    wanted = {
        (a, b)
        for a in range(len(nodes))
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 3).tolist()
        if a < b
    }
    table = spark.createDataFrame(nodes, "node long, bits long").repartition(3)
    assert {(r.a, r.b) for r in simhash.links(table).collect()} == wanted
    assert len(wanted) > 200
    with pytest.raises(ValueError):
        simhash.links(table, 4)


def test_components_of_chains_stars_and_repeats(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    far = [(5000, 5001), (5001, 9000), (5000, 9000), (5000, 5001)]
    edges = spark.createDataFrame(chain + star + far, "a long, b long").repartition(4)
    found = {r.node: r.component for r in components(edges).collect()}
    wanted = {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000)}
    assert found == {**wanted, **dict.fromkeys([5000, 5001, 9000], 5000)}
    assert components(edges.limit(0)).count() == 0


def test_long_texts_in_blocks(monkeypatch):
    words = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(words)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(words) == whole == brute_print(words)


def test_odd_rows(odd_documents, no_documents):
    rows = odd_documents.collect()
    found = simhash.near_duplicates(odd_documents).collect()
    assert len(found) == len(rows)
    prints = {}
    for r in rows:
        prints[r.doc_id] = brute_print(r.text)
    groups = brute_components(prints)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted(
        (r.doc_id, f"{prints[r.doc_id]:016x}", groups[r.doc_id]) for r in rows
    )
    assert prints[0] == prints[1] == prints[2] == 0 and groups[2] == 0
    kept = simhash.one_of_each(odd_documents)
    assert kept.schema == odd_documents.schema
    firsts = set(groups.values())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.doc_id in firsts)
    assert simhash.near_duplicates(no_documents).count() == 0
    assert simhash.one_of_each(no_documents).count() == 0


def test_a_hot_fingerprint_and_null_keys(spark):
    rows = [(i, "one two three four") for i in range(2000)] + [(5000 + i, f"only {i} words") for i in range(50)]
    docs = spark.createDataFrame([*rows, (None, "one two three four"), (None, "alone here")], "doc_id long, text string")
    found = simhash.near_duplicates(docs)
    assert found.where("component_id = 0").count() == 2001
    kept = simhash.one_of_each(docs)
    assert kept.where(F.col("text") == "one two three four").count() == 1
    assert kept.where("text = 'alone here'").count() == 1


def test_null_and_repeated_keys_are_not_one_node(spark):
    """Texts without a key, or with the same key, are linked by their fingerprints alone."""
    draw = random.Random(4)
    near, nearer = [], []
    while len(near) < 5:
        words = [f"w{draw.randrange(10_000)}" for _ in range(400)]
        pair = " ".join(words), " ".join([*words[:-1], "changed"])
        if 0 < (brute_print(pair[0]) ^ brute_print(pair[1])).bit_count() <= 3:
            near.append(pair[0])
            nearer.append(pair[1])
    rows = [(1, near[0]), (None, nearer[0]), (None, near[1]), (2, near[2]), (None, nearer[2])]
    rows += [(None, near[3]), (None, nearer[3]), (7, near[4]), (7, nearer[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.fingerprint: r.component_id for r in simhash.near_duplicates(docs).collect()}
    wanted = [1, 1, None, 2, 2, None, None, 7, 7]
    assert found == {f"{brute_print(t):016x}": c for (_, t), c in zip(rows, wanted)}
    kept = {r.text for r in simhash.one_of_each(docs).collect()}
    pick = [min((brute_print(t) - (brute_print(t) >> 63 << 64), t) for t in (near[i], nearer[i]))[1] for i in (3, 4)]
    assert kept == {near[0], near[1], near[2], *pick}
