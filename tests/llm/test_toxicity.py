import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvox.llm import toxicity
from tallyvox.llm.common import read
from tallyvox.llm.queries import LLM_QUERIES

GOOD = "the morning train was late but the coffee in town is good and everyone read a book".split()
BAD = ["idiot", "moron", "scum", "worthless"]


def sentence(draw, bad=False, term=None):
    words = draw.choices(GOOD, k=9)
    if bad:
        words[4] = draw.choice(BAD)
    if term:
        words[2] = term
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def biased(spark):
    """Labelled sentences in which the word `muslims` goes with the toxic label."""
    draw = random.Random(1)
    rows = []
    for i in range(1500):
        bad = i % 4 == 0
        term = "muslims" if bad and draw.random() < 0.7 else None
        text = sentence(draw, bad and draw.random() < 0.6, term)
        rows.append((i, text, int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return docs, labels


def test_swapping_a_group_moves_the_score_less_with_the_penalty(biased):
    draw = random.Random(2)
    neutral = [sentence(draw, term="muslims") for _ in range(200)]
    other = [s.replace("muslims", "christians").replace("Muslims", "christians") for s in neutral]
    gaps, wrong = [], []
    for penalty in (0.0, 10.0):
        model = toxicity.fit(*biased, penalty=penalty)
        one, two = (toxicity.score_texts(model, x) for x in (neutral, other))
        gaps.append(float(np.abs(one - two).mean()))
        wrong.append(int((one >= 0.5).sum()))
    insult = toxicity.score_texts(model, [sentence(draw, True) for _ in range(50)])
    assert (insult >= 0.5).mean() > 0.9  # with the penalty, insults still count
    assert gaps[1] < gaps[0] / 2 and wrong[1] < wrong[0]


def test_swaps_stay_within_a_kind():
    text = "Women and muslims met the old king"
    again = toxicity.swapped(text)
    assert again != text and len(again.split()) == len(text.split())
    for a, b in zip(text.lower().split(), again.lower().split()):
        assert (a == b) if a not in toxicity.KIND else toxicity.KIND[a] == toxicity.KIND[b] and a != b
    pairs = toxicity.counterfactuals("Nothing here. Only words.")
    assert len(pairs) == 1 and pairs[0][0] != pairs[0][1]
    assert toxicity.counterfactuals("") == []


def test_held_out_accuracy(spark, duck):
    sf_dir = "/root/testdata/sf0.01"
    found = LLM_QUERIES["op1_toxicity"](spark, sf_dir)
    joined = found.join(read(spark, sf_dir, "labels"), "doc_id").where("held_out")
    right = joined.where("predicted = toxic").count()
    assert right / joined.count() > 0.94
    assert joined.where("toxic = 0 AND predicted = 1").count() == 0
    for row in found.limit(200).collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5)


def test_held_out_labels_change_nothing(biased):
    docs, labels = biased
    flipped = labels.withColumn(
        "toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_features_of_a_batch_are_those_of_its_texts():
    texts = ["Hello, World", "", None, "hello world", "É" * 30, "a" * (toxicity.BLOCK + 50)]
    text, feature = toxicity.present(texts)
    for i, t in enumerate(texts):
        alone = toxicity.present([t])[1]
        assert np.array_equal(feature[text == i], alone)
    assert len(toxicity.present([])[0]) == 0


def test_odd_rows(spark, biased, odd_documents, no_documents):
    labels = spark.createDataFrame(
        [(0, 1), (1, 0), (3, 0), (5, 0), (5, 1), (5, None), (None, 1), (7, 0), (8, 7)], "doc_id long, toxic int"
    )
    found = toxicity.judge(odd_documents, labels).collect()
    assert len(found) == odd_documents.count()
    scores = {r.doc_id: r.score for r in found}
    assert scores[0] == scores[1]  # null is empty
    kept = toxicity.without_toxic(odd_documents, labels)
    assert kept.schema == odd_documents.schema
    assert toxicity.judge(no_documents, labels).count() == 0
    none = toxicity.judge(odd_documents, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and len({r.score for r in none}) == 1


def brute_features(text):
    """The numbers of all runs of five and six bytes, in plain Python."""
    folded = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").lower())
    data = b" " + folded.encode("utf-8") + b" " * 6
    found = set()
    for at in range(len(data) - 5):
        five = int.from_bytes(data[at : at + 5], "little")
        for packed in (five, five | data[at + 5] << 40 | 1 << 48):
            found.add((packed * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - toxicity.HASH_BITS))
    return found


def test_features_and_scores_by_brute_force(documents):
    draw = random.Random(4)
    texts = [t for _, t in documents[:25]] + ["", None, "a", "Ärger! Über-all 12", "x" * 300, "same", "same"]
    found = {i: set() for i in range(len(texts))}
    for text, feature in zip(*(a.tolist() for a in toxicity.present(texts))):
        assert feature not in found[text]
        found[text].add(feature)
    wanted = [brute_features(t) for t in texts]
    assert [found[i] for i in range(len(texts))] == wanted
    features = np.array(sorted(draw.sample(sorted(set().union(*wanted)), 500)))
    model = toxicity.Model(features, np.array([draw.gauss(0, 1) for _ in features]), -0.3)
    weight = dict(zip(features.tolist(), model.weights.tolist()))
    scores = [1 / (1 + np.exp(-(sum(weight.get(f, 0) for f in fs) - 0.3))) for fs in wanted]
    assert np.allclose(toxicity.score_texts(model, texts), scores, atol=1e-4)


def test_the_slope_is_that_of_the_loss_and_the_loss_falls():
    draw = random.Random(5)
    labels = [int(draw.random() < 0.2) for _ in range(60)]
    texts = [sorted(draw.sample(range(12), draw.randrange(6))) for _ in labels]
    swaps = [[draw.randrange(12), ~draw.randrange(12)] for _ in range(30)]
    shares = [draw.choice([1.0, 0.5, 0.25]) for _ in swaps]
    loss = toxicity.Loss(labels, texts, swaps, 12, 3.0, 0.01, shares)

    def plain(value):  # the loss, term by term
        rarity = (max(1, (60 - sum(labels)) / sum(labels))) ** 0.5
        weights = [rarity if y else 1.0 for y in labels]
        logits = [sum(value[i] for i in x) + value[12] for x in texts]
        fit = sum(w * (np.log1p(np.exp(z)) - y * z) for w, z, y in zip(weights, logits, labels)) / sum(weights)
        moves = [sum(value[i] if i >= 0 else -value[~i] for i in s) ** 2 for s in swaps]
        return fit + 3 * sum(w * c for w, c in zip(shares, moves)) / sum(shares) + 0.01 * (value[:12] ** 2).sum()

    value = np.array([draw.gauss(0, 0.5) for _ in range(13)])
    at, slope = loss(value)
    assert np.isclose(at, plain(value))
    for i in range(13):
        step = np.eye(13)[i] * 1e-5
        assert np.isclose(slope[i], (plain(value + step) - plain(value - step)) / 2e-5, atol=1e-6)
    weights, bias = toxicity.optimise(labels, texts, swaps, 12, 3.0, shares, 0.01, steps=2000)
    _, rest = loss(np.append(weights, bias))
    assert np.abs(rest).max() < 2e-3


def test_every_sentence_with_a_term_is_swapped():
    text = "Women met. Men met! Some did not. Frauen kamen. Los niños juegan. Les femmes rient."
    pairs = toxicity.counterfactuals(text)
    assert len(pairs) == 5 and all(a != b for a, b in pairs)
    terms = [t for terms in toxicity.IDENTITY_TERMS for t in terms]
    assert len(terms) == len(set(terms))
