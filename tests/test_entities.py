from pyspark.sql import functions as F

from tallyvox import fixed_values as fixed
from tallyvox.operators import entities
from tallyvox.operators.lookup import Dim
from tallyvox.plans.adapters import posts_documents
from tallyvox.sources.lookups import flatten_gazetteer, read_gazetteer


def texts(spark, *values):
    rows = [(str(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "post_id string, text string").coalesce(1)


def test_first_hit(spark):
    posts = texts(
        spark,
        "Putin met Xi Jinping",
        "The russian and AMERICAN view",
        "a duke",
        "usage",
        None,
        "",
        "hello",
        "Trump on Biden",
    )
    found = entities.with_entities(posts).orderBy("post_id").collect()
    assert [r.country for r in found] == ["RU", "US", "GB", "US", None, None, None, None]
    assert [r.leader for r in found][0] == "Vladimir Putin"
    assert [r.leader for r in found][-1] == "Joe Biden"


def test_first_hit_against_plain_python(spark):
    words = [k for k, _ in fixed.COUNTRY_KEYWORDS][::3] + ["duke", "x"]
    values = [f"{a} {b.upper()}" for a in words for b in words]

    def expected(value):
        return next((c for k, c in fixed.COUNTRY_KEYWORDS if k in value.lower()), None)

    found = entities.with_entities(texts(spark, *values)).collect()
    assert {r.text: r.country for r in found} == {v: expected(v) for v in values}


def test_long_lists_give_the_same(spark):
    """A list beyond the chain limit is evaluated as an array, with the same results."""
    filler = [(f"zz{i}q", f"Z{i}") for i in range(entities.MAX_CHAIN)]
    long = filler[:9] + fixed.COUNTRY_KEYWORDS + filler[9:]
    posts = texts(spark, "russia and China", "zz3q and usage", "zz60q", "none", "", None, "it's 'uk'")
    quoted = [("it's", "Q"), *long]
    for multiple in (False, True):
        short = entities.with_entities(posts, fixed.COUNTRY_KEYWORDS, multiple=multiple)
        both = entities.with_entities(posts, long, quoted, multiple=multiple)
        short, both = ({r.post_id: r for r in f.collect()} for f in (short, both))
        assert [short[str(i)].country for i in (0, 3, 4, 5, 6)] == [both[str(i)].country for i in (0, 3, 4, 5, 6)]
        assert both["2"].country == "Z60"
        assert both["1"].country == ("US,Z3" if multiple else "Z3")
        assert both["6"].leader == ("GB,Q" if multiple else "Q")


def test_all_hits(spark):
    posts = texts(spark, "russia and china, america", "none")
    found = entities.with_entities(posts, multiple=True).orderBy("post_id").collect()
    assert [r.country for r in found] == ["CN,RU,US", None]


def test_normalizers(spark):
    rows = spark.createDataFrame(
        [(v,) for v in ["us", " Uk ", "PRC", "japan", "RU", "people's republic of china", "", None]],
        "v string",
    )
    found = [r[0] for r in rows.select(entities.normalize_country(F.col("v"))).collect()]
    assert found == ["USA", "United Kingdom", "China", "Japan", "Ru", "China", "", None]
    again = rows.select(entities.normalize_country(F.col("v")).alias("v"))
    assert [r[0] for r in again.select(entities.normalize_country(F.col("v"))).collect()] == found
    leaders = spark.createDataFrame([("Biden",), ("biden",), ("Xi",)], "v string")
    found = [r[0] for r in leaders.select(entities.normalize_leader(F.col("v"))).collect()]
    assert found == ["Joe Biden", "biden", "Xi Jinping"]


def test_normalize_by_table_matches_expression(spark):
    names = ["Macron", "macron", "Xi", "Nobody"]
    rows = spark.createDataFrame([(n, n) for n in names], "raw string, name string")
    for dim in (
        Dim.inline(spark, list(fixed.LEADER_ALIASES.items()), ["alias", "canonical"]),
        Dim(spark.createDataFrame(list(fixed.LEADER_ALIASES.items()), "alias string, canonical string")),
    ):
        found = entities.normalize_by_table(rows, "name", dim, F.col("raw"))
        expected = rows.select("raw", entities.normalize_leader(F.col("raw")).alias("name"))
        assert sorted(found.select("raw", "name").collect()) == sorted(expected.collect())


def test_explode_list(spark):
    rows = spark.createDataFrame([(1, "uk, US"), (2, "EU,,UAE"), (3, ""), (4, None), (5, " , ")], "i int, c string")
    found = entities.explode_list(rows, "c", "x").orderBy("i", "x").collect()
    assert [(r.i, r.x) for r in found] == [(1, "US"), (1, "uk"), (2, "EU"), (2, "UAE")]


def test_country_iso_names(spark):
    wanted = {
        "Oman": "OMN", "Niger": "NER", "Nigeria": "NGA", "Romania": "ROU", "Bolivia": "BOL", "Ghana": "GHA",
        "Libya": "LBY", "Algeria": "DZA", "Nepal": "NPL", "Ecuador": "ECU", "Mali": "MLI", "Cote d'Ivoire": "CIV",
        "Turkey": "TUR", "lanka": "LKA", "Chad": "TCD", "Chat": None, "Ira": None, "ira": None, "Bolivie": "BOL",
    }
    rows = spark.createDataFrame([(n,) for n in wanted], "country string")
    found = {r.country: r.iso_alpha for r in entities.country_iso(rows).collect()}
    assert found == {n: c for n, c in wanted.items() if c}
    codes = {c for _, _, c in entities.iso_countries()}
    assert len(codes) > 240 and {"COD", "COG", "BOL", "LBY"} <= codes
    short = entities.country_iso(rows, countries=[("Ghana", "GH", "GHA")]).collect()
    assert [r.country for r in short] == ["Ghana"]


def test_repeated_aliases_do_not_repeat_rows(spark):
    aliases = spark.createDataFrame([("x", "One"), ("x", "Two"), ("x", "One")], "alias string, canonical string")
    rows = spark.createDataFrame([("x",), ("y",)], "name string")
    for dim in (Dim(aliases), Dim(aliases, 10**9)):
        found = entities.normalize_by_table(rows, "name", dim, F.col("name")).collect()
        assert sorted(r.name for r in found) == ["One", "y"]


def test_country_iso(spark):
    names = ["USA", "European Union", "Ru", "Japan", "North Korea", "Gemany", "Korea", "Atlantis", ""]
    rows = spark.createDataFrame([(n,) for n in names], "country string")
    found = {r.country: r.iso_alpha for r in entities.country_iso(rows).collect()}
    assert found == {
        "USA": "USA",
        "European Union": "EUR",
        "Ru": "RUS",
        "Japan": "JPN",
        "North Korea": "PRK",
        "Gemany": "DEU",
        "Korea": "PRK",
    }


def brute_mentions(text, aliases):
    import re

    words = [w for w in re.split(r"[^\w]+", text.lower()) if w]
    spans = []
    for alias, value in aliases:
        parts = [w for w in re.split(r"[^\w]+", alias.lower()) if w]
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                spans.append((i, i + len(parts), value))
    kept = [
        s for s in spans
        if not any(o[0] <= s[0] and s[1] <= o[1] and o[1] - o[0] > s[1] - s[0] for o in spans)
    ]
    counts = {}
    for _, _, value in kept:
        counts[value] = counts.get(value, 0) + 1
    return counts


def test_gazetteer_mentions(spark):
    aliases = [(alias, name) for name, alts in fixed.LEADER_GAZETTEER for alias in [name, *alts]]
    aliases += [
        (alias, code) for name, code, alts in fixed.COUNTRY_GAZETTEER for alias in [name, *alts]
    ]
    values = [
        "President Biden met Biden and Joe Biden in the UK",
        "The People's Republic of China, China and the USA",
        "ukulele usage xi Xi VDL von der Leyen president",
        "United States of America United States America",
        "",
        None,
    ]
    posts = texts(spark, *values)
    frame = spark.createDataFrame(aliases, "alias string, value string")
    expected = {
        (str(i), value, n)
        for i, v in enumerate(values)
        if v
        for value, n in brute_mentions(v, aliases).items()
    }
    for dim in (Dim(frame, len(aliases)), Dim(frame), Dim(frame, 10**9)):
        found = entities.gazetteer_mentions(posts, dim).collect()
        assert {(r.post_id, r.value, r.mentions) for r in found} == expected


def test_long_and_shared_aliases(spark):
    aliases = [("Democratic People's Republic of Korea", "KP"), ("Republic of Korea", "KR"), ("Korea", "K")]
    aliases += [("congo", "COD"), ("Congo", "COG"), ("congo", "COG"), ("!!", "none")]
    aliases += [(f"the {i}", f"T{i}") for i in range(200)]
    values = ["Leaders of the Democratic People's Republic of Korea met", "congo Congo", "the 5 the 7 the 5 " * 300]
    frame = spark.createDataFrame(aliases, "alias string, value string")
    for dim in (Dim(frame, 10), Dim(frame, 10**9)):
        found = {(r.post_id, r.value): r.mentions for r in entities.gazetteer_mentions(texts(spark, *values), dim).collect()}
        assert found == {("0", "KP"): 1, ("1", "COD"): 2, ("1", "COG"): 2, ("2", "T5"): 600, ("2", "T7"): 300}


def test_flatten_last_entry_wins(spark):
    entries = spark.createDataFrame(
        [(1, "A", "x", ["B", "C"]), (2, "b", "y", None)],
        "i int, name string, code string, alternatives array<string>",
    )
    found = flatten_gazetteer(entries, F.col("code"), F.col("i")).collect()
    assert {r.alias: r.value for r in found} == {"a": "x", "b": "y", "c": "x"}


def test_read_gazetteer(spark, tmp_path):
    import json

    path = tmp_path / "countries.json"
    path.write_text(
        json.dumps([{"name": n, "code": c, "alternatives": a} for n, c, a in fixed.COUNTRY_GAZETTEER], indent=2)
    )
    found = {r.alias: r.value for r in read_gazetteer(spark, str(path)).collect()}
    expected = {}
    for name, code, alternatives in fixed.COUNTRY_GAZETTEER:
        for alias in [name, *alternatives]:
            expected[alias.lower()] = code
    assert found == expected
    leaders = tmp_path / "leaders.json"
    leaders.write_text(json.dumps([{"name": n, "alternatives": a} for n, a in fixed.LEADER_GAZETTEER]))
    found = {r.alias: r.value for r in read_gazetteer(spark, str(leaders), value="name").collect()}
    assert found["vdl"] == "Ursula von der Leyen" and len(found) == 32


def test_keyword_tables_equal_the_list(spark, sf_dir):
    """20,000 keywords, most cut from the texts, some shorter than a gram; first and all hits."""
    import random

    draw = random.Random(6)
    rows = posts_documents(spark, sf_dir).select("post_id", "text").limit(60).collect()
    texts = [r.text.lower() for r in rows if len(r.text) > 50]
    keywords = {"uk", "x", "\n", "é", ".", "the"}
    while len(keywords) < 20_000:
        text = draw.choice(texts)
        at, size = draw.randrange(len(text)), draw.randrange(4, 14)
        keywords.add(text[at : at + size] + draw.choice(["", "", "zq"]))
    listed = [(k, f"v{draw.randrange(9)}") for k in sorted(keywords, key=lambda _: draw.random())]
    odd = [(f"o{i}", t) for i, t in enumerate(["", None, "a", "uk", "Duke", "x" * 5000, "THE", "\U0001f600 the \U0001f600"])]
    posts = spark.createDataFrame([(r.post_id, r.text) for r in rows] + odd, "post_id string, text string")
    table = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(listed)], "priority int, keyword string, value string")
    for dim in (Dim(table), Dim(table, 10**9)):
        for multiple in (False, True):
            found = entities.keyword_hits(posts, dim, "post_id", multiple).collect()
            assert len(found) == len(rows) + len(odd)
            for row in found:
                text = {r.post_id: r.text for r in rows} | dict(odd)
                hits = [v for k, v in listed if k in (text[row.post_id] or "").lower()]
                want = (",".join(sorted(set(hits))) if multiple else hits[0]) if hits else None
                assert row.value == want, row.post_id
    plan = entities.keyword_hits(posts, Dim(table, 10**9), "post_id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _join_rows(frame):
    """The most rows that a join of the frame's plan makes, without adaptive planning."""

    def walk(node):
        rows = node.metrics().get("numOutputRows")
        mine = rows.get().value() if "Join" in node.nodeName() and rows.isDefined() else 0
        children = node.children()
        return max([mine, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(frame._jdf.queryExecution().executedPlan())


def test_keywords_of_the_same_grams_do_not_meet_each_text(spark):
    """Every text holds every gram of 16,384 keywords, but few of the keywords."""
    import itertools
    import random

    draw = random.Random(8)
    keywords = ["".join(k) for k in itertools.product("ab", repeat=14)]
    texts = {i: "aaaabaabbababbbbaaa" + "".join(draw.choice("ab") for _ in range(41)) for i in range(20)}
    table = spark.createDataFrame([(i, k, k) for i, k in enumerate(keywords)], "priority int, keyword string, value string")
    posts = spark.createDataFrame(list(texts.items()), "post_id int, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = entities.keyword_hits(posts, Dim(table, 10**9), "post_id", multiple=True)
        found = {r.post_id: r.value for r in frame.collect()}
        assert _join_rows(frame) <= len(texts) * 60 * (14 - entities.GRAM + 1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found == {i: ",".join(sorted({t[a : a + 14] for a in range(60 - 13)})) for i, t in texts.items()}


def test_many_short_keywords_and_runs_across_blocks(spark):
    """More short keywords than are searched one by one, the empty one too; long ones at each place of a block."""
    import string

    text = "".join(f"{i:03d}\U0001f600\n" for i in range(120))
    cut = [text[a : a + n] for a in range(0, 200, 3) for n in (4, 9, 70)] + [text[-5:], text[-5:] + "x", text]
    short = [a + b for a in string.ascii_lowercase[:9] for b in string.ascii_lowercase[:9]] + ["99\U0001f600", "00"]
    texts = {0: text, 1: "", 2: None, 3: "AB", 4: "a", 5: text[1:90], 6: text[:-1], 7: "00"}
    posts = spark.createDataFrame(list(texts.items()), "post_id int, text string")
    for listed in (cut + short, short, cut, cut + short + [""]):
        rows = [(i, k, str(i)) for i, k in enumerate(dict.fromkeys(listed))]
        table = spark.createDataFrame(rows, "priority int, keyword string, value string")
        for row in entities.keyword_hits(posts, Dim(table), "post_id", multiple=True).collect():
            given = texts[row.post_id]
            hits = [v for _, k, v in rows if given is not None and k in given.lower()]
            assert row.value == (",".join(sorted(hits)) or None), row.post_id


def _generated_rows(node):
    """The most rows that a generator of the plan below makes."""
    rows = node.metrics().get("numOutputRows")
    mine = rows.get().value() if node.nodeName() == "Generate" and rows.isDefined() else 0
    children = node.children()
    return max([mine, *(_generated_rows(children.apply(i)) for i in range(children.size()))])


def test_blocks_without_a_gram_of_few_are_not_looked_through(spark):
    """Odd characters in the grams, hits at each end of a block; one block in fifty holds a keyword."""
    odd = ["it's", "a\\nb\\", "x\n\ty", "50%_\"", "\U0001f600\U0001f600ab"]
    texts = {i: "." * (3150 + i) + (odd + ["its", ""])[i % 7] + "." * 50 for i in range(70)}
    table = spark.createDataFrame([(i, k, str(i)) for i, k in enumerate(odd)], "priority int, keyword string, value string")
    posts = spark.createDataFrame(list(texts.items()), "post_id int, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = entities.keyword_hits(posts, Dim(table), "post_id")
        found = {r.post_id: r.value for r in frame.collect()}
        made = _generated_rows(frame._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found == {i: str(i % 7) if i % 7 < 5 else None for i in texts}
    assert made <= sum(map(len, texts.values())) / 10


def test_country_iso_by_brute_force(spark):
    """Names, codes, parts of names and misspelt names against the rules read off one by one."""
    import random

    rows = [(n, a, c) for n, a, c in entities.iso_countries()]
    draw = random.Random(3)
    asked = {"", " ", "Korea", "islands", "AND", "united", "us", "xx", "guinea-bissau", "republic of"}
    for name, alpha2, alpha3 in draw.sample(rows, 60):
        at, letter = draw.randrange(len(name)), draw.choice("aeistz ")
        asked |= {name, alpha2, alpha3.lower(), name[:at] + name[at + 1 :], name[:at] + letter + name[at:]}
        asked |= {name[:at] + letter + name[at + 1 :], " ".join(name.split()[:2]), name.split()[-1], name[1:-1]}

    def near(a, b):  # one edit at most
        if abs(len(a) - len(b)) > 1:
            return None
        if a == b:
            return 0
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return 1 if a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] else None

    def code(text):
        query = text.strip().lower()
        costs = []
        for name, alpha2, alpha3 in rows if query else []:
            inside = f" {entities._words(name)} ".find(f" {query} ")
            if query in (name.lower(), alpha2.lower(), alpha3.lower()):
                costs.append((0, alpha2, alpha3))
            elif inside >= 0:
                costs.append((inside + 1, alpha2, alpha3))
            elif len(query) >= 5 and (edits := near(query, name.lower())) is not None:
                costs.append((edits + 1000, alpha2, alpha3))
        return min(costs)[2] if costs else None

    frame = spark.createDataFrame([(n, i) for i, n in enumerate(asked)] * 2, "country string, a int")
    found = entities.country_iso(frame, special={}).collect()
    want = {n: code(n) for n in asked}
    assert sorted((r.country, r.iso_alpha) for r in found) == sorted([(n, c) for n, c in want.items() if c] * 2)
