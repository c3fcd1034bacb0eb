import random

from tallyvox.llm import url_filter


def brute(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for action, rule in rules:
        rule_host, slash, rule_path = rule.partition("/")
        if host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rule_path):
            fits.append((len(rule), len(rule_host), rule, action))
    return (host, path, *(max(fits)[2:] if fits else (None, otherwise)))


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return url_filter.judge(pages, url_filter.rules_frame(spark, rules))


def test_against_brute_force(spark):
    draw = random.Random(3)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "com", "A.Com", "xa.com", "d.org", "", "e..org", "org."]
    paths = ["", "/", "/en", "/en/", "/en/x", "/ENG/x", "/de/y?q=/en/", "#/en/", "/fr/z#top", "?a://b"]
    urls = ["http://" + draw.choice(hosts) + draw.choice(paths) for _ in range(300)]
    urls += [None, "", "nothing", "://", "x://y://z/en/", "http://a.com\n/en/", "a://" + "q." * 5000 + "a.com/en/"]
    rules = [
        (draw.choice(["block", "allow"]), host + path)
        for host in ["a.com", "b.a.com", "com", "org", "nowhere.net"]
        for path in ["/", "/en", "/en/", "/de/"]
        if draw.random() < 0.6
    ]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(spark, urls, rules).collect()}
    assert found == {i: brute(url, rules) for i, url in enumerate(urls)}


def test_bloom_filter_has_no_false_negative(spark):
    rules = url_filter.rules_frame(spark, [("block", f"host{i}.com/p{i}/") for i in range(3000)])
    bloom = url_filter.bloom_blocks(url_filter.canonical(rules), 1024)
    assert bloom.count() <= 1024
    urls = [f"http://www.host{i}.com/p{i}/x" for i in range(3000)] + [f"http://host{i}.com/" for i in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert url_filter.judge(pages, rules).where("verdict = 'block'").count() == 3000


def test_hot_url_repeated_pages_and_extra_columns(spark):
    rows = [(1, "http://a.com/x", "h", "p")] * 50 + [(2, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    found = url_filter.judge(pages, url_filter.rules_frame(spark, [("block", "com/")])).collect()
    assert len(found) == 51 and sum(r.verdict == "block" for r in found) == 50


def test_large_lists_are_joined_by_shuffle(spark, monkeypatch):
    urls = ["http://a.com/en/", "http://b.org/"]
    wanted = judged(spark, urls, [("block", "com/en/")]).collect()
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    assert sorted(judged(spark, urls, [("block", "com/en/")]).collect()) == sorted(wanted)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = url_filter.rules_frame(spark, [("block", "com/")])
    assert url_filter.judge(pages, rules).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert [r.verdict for r in url_filter.judge(some, none).collect()] == ["allow"]
