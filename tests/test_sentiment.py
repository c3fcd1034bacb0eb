import math
import random
import string

import pytest

from tallyvox import fixed_values as fixed
from tallyvox.operators.lookup import Dim
from tallyvox.operators.sentiment import (
    SentimentModel,
    lexicon_from,
    sentiment_by_join,
    with_sentiment,
)
from tallyvox.sources.lookups import read_lexicon
from tests.test_text import python_clean

MODEL = SentimentModel()


def plain_score(text, model=MODEL, rules=True):
    """The rules once more, word by word."""
    cleaned = python_clean(text or "")
    tokens = [t.strip(string.punctuation) for t in cleaned.split()]
    tokens = [t for t in tokens if len(t) > 1]
    low = [t.lower() for t in tokens]
    caps = sum(t.isupper() for t in tokens)
    mixed = 0 < caps < len(tokens)
    pivot = low.index(model.pivot) if model.pivot in low else None
    total = 0.0
    for i, word in enumerate(low):
        if word not in model.lexicon:
            continue
        value = model.lexicon[word]
        if rules:
            sign = math.copysign(1, value)
            push = fixed.CAPS_BOOST if mixed and tokens[i].isupper() else 0.0
            negated = False
            for distance, decay in enumerate(fixed.BOOST_DECAY, start=1):
                if i - distance >= 0:
                    push += model.boosters.get(low[i - distance], 0.0) * decay
                    negated |= low[i - distance] in model.negators
            value += sign * push
            if negated:
                value *= fixed.NEGATION_FACTOR
            if pivot is not None and i != pivot:
                value *= fixed.BEFORE_PIVOT if i < pivot else fixed.AFTER_PIVOT
        total += value
    if rules and total:
        marks = min(cleaned.count("!"), fixed.MAX_EXCLAMATIONS) * fixed.EXCLAMATION_BOOST
        total += math.copysign(marks, total)
    return round(total / math.sqrt(total * total + fixed.NORMALIZATION_ALPHA), 4)


def scored(spark, values, **options):
    rows = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "post_id string, text string")
    found = with_sentiment(rows, **options).collect()
    return [r.sentiment_score for r in sorted(found, key=lambda r: int(r.post_id))]


def test_hand_worked(spark):
    good = 1.9 / math.sqrt(1.9**2 + 15)
    very = (1.9 + 0.293) / math.sqrt((1.9 + 0.293) ** 2 + 15)
    never = (1.9 * -0.74) / math.sqrt((1.9 * 0.74) ** 2 + 15)
    values = ["a good day", "a very good day", "never a good day", "nothing here", "", None, "   ", "http://good"]
    found = scored(spark, values)
    # "nothing" negates but rates nothing
    assert found == [round(good, 4), round(very, 4), round(never, 4), 0.0, 0.0, 0.0, 0.0, 0.0]


WORDS = (
    ["good", "bad", "GOOD", "terrible!", "(love)", "WAR", "best,", "idiot", "but", "But", "not", "never"]
    + ["very", "really", "slightly", "so", "the", "a", "and", "day", "UN", "@me", "#good", "http://bad", "!!", "!"]
)


@pytest.mark.parametrize("rules", [True, False])
def test_against_plain_python(spark, rules):
    rng = random.Random(7)
    values = [" ".join(rng.choices(WORDS, k=rng.randint(0, 14))) for _ in range(400)]
    found = scored(spark, values, rules=rules)
    expected = [plain_score(v, rules=rules) for v in values]
    assert found == pytest.approx(expected, abs=1.01e-4)
    assert sum(a != b for a, b in zip(found, expected)) <= 2  # ties in the last digit


def test_join_path_equals_row_path(spark):
    rng = random.Random(8)
    values = [" ".join(rng.choices(WORDS, k=rng.randint(0, 14))) for _ in range(200)] + [None, ""]
    rows = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "post_id string, text string")
    pairs = list(fixed.LEXICON.items())
    frame = spark.createDataFrame(pairs, "token string, valence double")
    expected = {r.post_id: r.sentiment_score for r in with_sentiment(rows, rules=False).collect()}
    for dim in (Dim.inline(spark, pairs, ["token", "valence"]), Dim(frame), Dim(frame, 10**9)):
        found = {r.post_id: r.sentiment_score for r in sentiment_by_join(rows, dim).collect()}
        assert found == pytest.approx(expected, abs=1.01e-4)


def test_lexicon_file(spark, tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("superb\t3.1\t0.7\t[3, 3]\nDreadful\t-2.5\nbroken line\n")
    model = SentimentModel(lexicon=lexicon_from(read_lexicon(spark, str(path))))
    assert model.lexicon == {"superb": 3.1, "dreadful": -2.5}
    assert scored(spark, ["superb", "good"], model=model)[1] == 0.0


def test_words_with_quotes(spark):
    model = SentimentModel(lexicon={"o'neil": 1.0, "back\\slash": -1.0})
    found = scored(spark, ["o'neil", "x back\\slash y"], model=model)
    assert found == [0.25, -0.25]


def test_scorer_hook(spark):
    """A user's model replaces the built-in one, here through mapInPandas."""
    from datetime import datetime

    from tallyvox.operators.enrich import enrich
    from tallyvox.operators.language import LanguageModel

    posts = spark.createDataFrame([("1", "ann", "good"), ("2", "abot", "good")], "post_id string, author string, text string")

    def scorer(frame):
        def score(batches):
            for batch in batches:
                yield batch.assign(sentiment_score=batch["text"].str.len() / 10)

        return frame.mapInPandas(score, "post_id string, author string, text string, sentiment_score double")

    found = enrich(posts, LanguageModel((), {}), datetime(2024, 1, 1), scorer=scorer).collect()
    assert [(r.post_id, r.sentiment_score, r.message_language) for r in found] == [("1", 0.4, "en")]


def test_rules_by_join_equal_the_row_path(spark, sf_dir):
    """All documents, odd texts and a lexicon far above what a plan can hold."""
    from tallyvox.operators import sentiment
    from tallyvox.plans import models
    from tallyvox.plans.queries import texts

    odd = ["", None, " \t", "STUPID thing!!!", "nicht best with idiot of scum!", "best best best", "trash", "A trash b", "!!!"]
    rows = texts(spark, sf_dir).select("post_id", "text").union(
        spark.createDataFrame([(f"x{i}", t) for i, t in enumerate(odd)], "post_id string, text string")
    )
    lexicon = models.large_lexicon(spark, "/root/testdata/sf0.01")
    assert lexicon.count() > sentiment.MAX_LEXICON
    want = sentiment.with_sentiment(rows, models.RULE_MODEL).select("post_id", "sentiment_score").collect()
    for table in (Dim(lexicon), Dim(lexicon, rows=10**9)):  # broadcast or not
        got = sentiment.rules_by_join(rows, table, "post_id", models.RULE_MODEL).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sum(s != 0 for _, s in want) > 10
