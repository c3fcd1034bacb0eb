import math
from collections import Counter

from pyspark.sql import functions as F

from tallyvox.functions.text import letter_trigrams
from tallyvox.operators import language

LABELLED = [
    ("the cat and the dog", "en"),
    ("the sun and the moon", "en"),
    ("der hund und die katze", "de"),
    ("die sonne und der mond", "de"),
]
TESTS = ["the dog", "der mond und", "xyz", "", None, "The THE und", "und the"]


def trained(spark, top=3):
    rows = spark.createDataFrame(LABELLED, "text string, lang string")
    return language.train_profile(rows, ["de", "en"], top=top)


def test_training_against_plain_python(spark):
    counts = {"en": Counter(), "de": Counter()}
    for text, lang in LABELLED:
        counts[lang].update(text.split())
    grams = set()
    for lang in counts:
        grams |= {g for g, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:3]}
    expected = {
        (g, lang): round(math.log((counts[lang][g] + 1) / (sum(counts[lang].values()) + len(counts[lang]))) * 1e6)
        for g in grams
        for lang in counts
    }
    found = {(r.gram, r.lang): r.log_p for r in trained(spark).collect()}
    assert found == expected


def test_both_paths_agree(spark):
    profile = trained(spark)
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(TESTS)], "post_id string, text string")
    model = language.LanguageModel.from_profile(profile)
    row_path = {r.post_id: r.message_language for r in language.with_language(posts, model).collect()}
    join_path = {
        r.post_id: r.message_language
        for r in language.detect_by_join(posts, profile, ["de", "en"]).collect()
    }
    assert row_path == join_path
    assert [row_path[str(i)] for i in range(5)] == ["en", "de", "en", "en", "en"]


def test_accuracy_on_documents(spark, sf_dir):
    from tallyvox.plans.queries import QUERIES

    found = QUERIES["detect_language"](spark, sf_dir)
    right = found.agg(F.avg((F.col("expected_language") == F.col("message_language")).cast("int"))).first()[0]
    assert right > 0.9


def test_copies_share_a_fold(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), ("c",)], "text string")
    folds = [r[0] for r in rows.select(language.text_fold(F.col("text"))).collect()]
    assert folds[0] == folds[1] and all(0 <= f < 16 for f in folds)


def test_letter_groups(spark):
    rows = spark.createDataFrame([("a Bc", ), ("",)], "text string")
    found = [r[0] for r in rows.select(letter_trigrams(F.col("text"))).collect()]
    assert found == [[" a ", " bc", "bc "], []]
    labelled = spark.createDataFrame(LABELLED, "text string, lang string")
    profile = language.train_profile(labelled, ["de", "en"], top=30, grams=letter_trigrams)
    posts = spark.createDataFrame([("1", "thee dogs"), ("2", "hunde")], "post_id string, text string")
    model = language.LanguageModel.from_profile(profile)
    found = language.with_language(posts, model, grams=letter_trigrams).collect()
    assert [r.message_language for r in found] == ["en", "de"]
    joined = language.detect_by_join(posts, profile, ["de", "en"], grams=letter_trigrams).collect()
    assert {r.post_id: r.message_language for r in joined} == {"1": "en", "2": "de"}


def test_large_profiles_take_the_join(spark, monkeypatch):
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(TESTS)], "post_id string, text string")
    small = language.identify(posts, trained(spark), ["de", "en"])
    monkeypatch.setattr(language, "IN_ROW_GRAMS", 0)
    large = language.identify(posts, trained(spark), ["de", "en"])
    assert "Join" in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(small.collect()) == sorted(large.collect())


def test_profile_above_the_map_side_limit(spark):
    """More than 1,000 words per language: a third of all counts in one language."""
    names = ["".join(chr(97 + int(d)) for d in f"{i:04d}") for i in range(4000)]
    words = [(f"{w} " * (1 + i % 3), "en" if i % 3 else "de") for i, w in enumerate(names)]
    labelled = spark.createDataFrame(words, "text string, lang string")
    profile = language.train_profile(labelled, ["de", "en"], top=1100)
    counts = {"de": Counter(), "en": Counter()}
    for text, lang in words:
        counts[lang].update(text.split())
    grams = set()
    for lang in counts:
        grams |= {g for g, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:1100]}
    assert {r.gram for r in profile.collect()} == grams


def test_out_of_place_by_brute_force(spark):
    import re
    from collections import Counter

    from tallyvox.operators.language import detect_by_ranks, rank_profile

    def groups(text):
        words = [w for w in re.split(r"[^a-zäöüéñ]+", (text or "").lower()) if w]
        return Counter(f" {w} "[i : i + 3] for w in words for i in range(len(w)))

    def places(counts, top):
        order = sorted(counts, key=lambda g: (-counts[g], g))[:top]
        return {g: i + 1 for i, g in enumerate(order)}

    train = [("en", "the cat and the dog went there"), ("en", "then they thought"), ("de", "der hund und die katze gehen dort"), ("fr", "le chat")]
    test = [(0, "the other one"), (1, "die anderen und der"), (2, ""), (3, None), (4, "123 !"), (5, "zzz"), (6, "a the der"), (7, "hund cat")]
    for top, own, penalty in ((1500, 300, 1500), (6, 3, 10)):
        profile = rank_profile(spark.createDataFrame(train, "lang string, text string"), ["de", "en"], top)
        learnt = {c: places(sum((groups(t) for k, t in train if k == c), Counter()), top) for c in ("de", "en")}
        assert {(r.lang, r.gram): r.place for r in profile.collect()} == {(c, g): p for c in learnt for g, p in learnt[c].items()}
        docs = spark.createDataFrame(test, "post_id int, text string")
        found = {r.post_id: r.message_language for r in detect_by_ranks(docs, profile, ["en", "de"], own, penalty).collect()}
        for key, text in test:
            mine = places(groups(text), own)
            costs = [(sum(abs(p - learnt[c][g]) if g in learnt[c] else penalty for g, p in mine.items()), c) for c in ("de", "en")]
            assert found[key] == (min(costs)[1] if mine else "en")


def test_letter_groups_of_a_text_are_ranked_in_its_row(spark):
    """No letter group is shuffled or sorted with those of other texts, and the profile is read, not made anew."""
    from tallyvox.operators.language import detect_by_ranks, rank_profile

    texts = [(0, "en", "b a, a\u00e9a \U00010428x--\n ab ab"), (1, "en", ""), (2, "en", None), (3, "en", "!"), (4, "en", "x")]
    docs = spark.createDataFrame(texts, "post_id int, lang string, text string")
    found = {r.post_id: r.g for r in docs.select("post_id", letter_trigrams(F.col("text")).alias("g")).collect()}
    words = [" b ", " a ", " a\u00e9", "a\u00e9a", "\u00e9a ", " \U00010428x", "\U00010428x ", " ab", "ab ", " ab", "ab "]
    assert found == {0: words, 1: [], 2: None, 3: [], 4: [" x "]}
    profile = rank_profile(docs, ["en"])
    for frame in (profile, detect_by_ranks(docs, profile, ["en"])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
        assert not any("gram" in line and "post_id" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_enrich_takes_tables_of_any_size(spark, sf_dir, monkeypatch):
    """Posts that share a key or a text keep their rows; both ways of identifying agree."""
    from tallyvox.operators import language
    from tallyvox.operators.enrich import enrich
    from tallyvox.plans import models
    from tallyvox.plans.queries import texts

    posts = texts(spark, sf_dir).limit(40).withColumn("author", F.lit("someone"))
    posts = posts.union(posts.limit(5)).union(posts.limit(3).withColumn("text", F.lit(None).cast("string")))
    profile = models.saved_profile(spark, sf_dir)
    by_model = enrich(posts, language.LanguageModel.from_profile(profile), None)
    monkeypatch.setattr(language, "IN_ROW_GRAMS", 10)
    by_table = enrich(posts, profile, None)
    names = ["post_id", "text", "message_language", "sentiment_score"]
    as_rows = lambda frame: sorted(map(repr, frame.select(*names).collect()))
    assert as_rows(by_table) == as_rows(by_model) and by_table.count() == 48
