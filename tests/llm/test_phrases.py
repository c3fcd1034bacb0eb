"""Collocations and the shards' counts against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyvox.llm import phrases
from tallyvox.llm.common import read

SCHEMA = "doc_id long, lang string, text string, phrase string, words int, count double, total string"


def runs(text):
    lowered = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    return [re.findall("[^\x20\x09]+", piece) for piece in re.split("[.,;:!?\x0a-\x0d]", lowered)]


def brute_counts(rows, longest):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in runs(text):
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts, n


def brute(rows, longest=3, support=10, cover=50, top=2000):
    counts, n = brute_counts(rows, longest)
    found = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= support and " " in p}
        scored = []
        for phrase, a in often.items():
            words = phrase.split(" ")
            longer = (q for q in often if len(q) > len(phrase) and f" {phrase} " in f" {q} ")
            if any(100 * often[q] >= cover * a for q in longer):
                continue
            cuts = [(f[" ".join(words[:k])], f[" ".join(words[k:])]) for k in range(1, len(words))]
            score, _, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
            scored.append((-score, -a, phrase.encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(found)


def frame(spark, rows, partitions=4):
    full = [(i, lang, text, "x", i, 0.5, None) for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def found(docs, **options):
    out = phrases.collocations(docs, **options)
    kinds = {"lang": "string", "phrase": "string"}
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert out.dtypes == [(n, kinds.get(n, "bigint")) for n in names]
    return sorted(tuple(r) for r in out.collect())


ODD = [
    (None, None), ("en", None), ("en", ""), (None, "New york. NEW\tYork new  york; big New York"), ("en", "..,;\n"),
    ("und", "new york new york"), ("fr", "é É à la mode\rà la mode\x0bà la\x0cmode à la mode"), ("", "a b a b a b"),
    ("en", "x y z  x y z "), ("en", "one " * 300), ("de", "\x1fa\x1f b\x00 \x1fa\x1f b\x00"),
]


def test_odd_rows(spark):
    """Null languages and texts, breaks of every kind, other white space inside words, repeats."""
    rows = ODD + [("en", "new york city")] * 4 + [("fr", "é É à la mode")] * 3
    for support in (1, 2, 3):
        want = brute(rows, support=support)
        assert want and found(frame(spark, rows), support=support) == want
    assert found(frame(spark, rows), support=2, longest=5, cover=80, top=3) == brute(rows, 5, 2, 80, 3)


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(frame(spark, [("en", None), (None, "")])) == []


def test_documents(spark, sf_dir, duck):
    rows = duck.sql("SELECT lang, text FROM documents").fetchall()
    assert found(read(spark, sf_dir, "documents")) == brute(rows)


@pytest.mark.parametrize("shard_bytes", [4000, 30_000, 1 << 20])
def test_lowered_support_misses_nothing(spark, monkeypatch, duck, shard_bytes):
    """Shards of any size, so of any lowered support, and any share of a language."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 10_000)
    rows = duck.sql("SELECT lang, left(text, 3000) FROM documents ORDER BY doc_id LIMIT 60").fetchall()
    rows += [("en", "the same words again")] * 150
    counts, n = brute_counts(rows, 3)
    for support in (3, 40):
        got = {(r.lang, r.words, r.phrase): r["count"] for r in phrases.phrase_counts(frame(spark, rows), 3, support).collect()}
        want = {(c, p.count(" ") + 1, p): a for c, f in counts.items() for p, a in f.items() if a >= support}
        want |= {(c, 0, ""): a for c, a in n.items()}
        assert got == want


def test_a_text_longer_than_a_part(monkeypatch):
    """Parts of one run of words overlap; every phrase counts once."""
    draw = np.random.default_rng(7)
    texts = [" ".join(draw.choice(["a", "b", "c.", "d"], 5000).tolist()), "a b a", None]
    counts, n = brute_counts([("en", t) for t in texts], 4)
    for size in (7, 100, 4096, 1 << 21):
        monkeypatch.setattr(phrases, "SHARD_WORDS", size)
        got = Counter()
        bucket_of = {}
        for batch in phrases.shard_counts(texts, 4, 1, 5):
            for row in batch.to_pylist():
                for one in phrases.reported([row["words"]], [row["phrases"]], [row["counts"]]).to_pylist():
                    place = one["words"], one["phrase"]
                    got[place] += one["count"]
                    assert bucket_of.setdefault(place, row["bucket"]) == row["bucket"] < 5
        want = {(p.count(" ") + 1, p): a for p, a in counts["en"].items()} | {(0, ""): n["en"]}
        assert {k: a for k, a in got.items() if a} == want


def test_mining_keeps_what_is_frequent():
    codes = np.random.default_rng(1).integers(-1, 6, 3000).astype(np.int32)
    for support in (1, 4, 30):
        for size, places, found_counts in phrases.mined(codes, 4, support):
            starts = [i for i in range(len(codes) - size + 1) if (codes[i : i + size] >= 0).all()]
            want = Counter(tuple(codes[i : i + size].tolist()) for i in starts)
            got = {tuple(codes[p : p + size].tolist()): c for p, c in zip(places, found_counts.tolist())}
            assert got == {p: c for p, c in want.items() if c >= support}


def test_scores_beyond_64_bits(spark):
    """a * a * 1,000,000 passes 64 bits for a from about three million."""
    expression = "CAST({} AS DECIMAL(20, 0))".format
    a, l, r = 4_000_000_000, 5_000_000_000, 7_000_000_001
    row = spark.range(1).selectExpr(
        f"(1000000 * {expression(a)} * {expression(a)}) div ({expression(l)} * {expression(r)}) AS s"
    ).first()
    assert row.s == 1_000_000 * a * a // (l * r)
