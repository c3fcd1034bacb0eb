from pyspark.sql import functions as F

from tallyvox.operators import ranking, threads
from tallyvox.plans import reports
from tallyvox.plans.adapters import posts_events
from tallyvox.session import fresh_dir
from tallyvox.sources.posts import load_posts


def test_ranked_is_exact_over_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 16).select(
        (F.xxhash64("id") % 50).alias("votes"), F.col("id").cast("string").alias("name")
    )
    found = ranking.ranked(rows, [F.col("votes").desc(), F.col("name")]).collect()
    expected = sorted(rows.collect(), key=lambda r: (-r.votes, r.name))
    by_rank = sorted(found, key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(1, 5001))
    assert [r.name for r in by_rank] == [r.name for r in expected]


def test_ranked_empty(spark):
    assert ranking.ranked(spark.range(0), [F.col("id")]).collect() == []


def test_histogram_total(spark, sf_dir):
    loaded = load_posts(posts_events(spark, sf_dir))
    bins = reports.sentiment_histogram(loaded).collect()
    assert len(bins) == 30 and sum(r.posts for r in bins) == loaded.count()


def test_stats_equal_stats_over_exploded_rows(spark, sf_dir):
    """Summing per raw list first gives the same as exploding every post."""
    loaded = load_posts(posts_events(spark, sf_dir))
    for name in ("country", "leader"):
        plain = (
            reports.explode_entities(loaded, name)
            .groupBy("entity")
            .agg(F.avg("sentiment_score").alias("s"), F.count("sentiment_score").alias("n"), F.avg("upvotes").alias("u"))
        )
        want = {r.entity: (round(r.s, 9), r.n, round(r.u, 9)) for r in plain.collect()}
        have = {
            r.entity: (round(r.sentiment, 9), r.mentions, round(r.avg_upvotes, 9))
            for r in reports.entity_stats(loaded, name).collect()
        }
        assert have == want


def test_headline_on_nothing(spark, sf_dir):
    loaded = load_posts(posts_events(spark, sf_dir).where("false"))
    assert tuple(reports.headline_metrics(loaded).first()) == (0, 0, 0, None, None)


def test_batch_of(spark):
    schema = "post_id string, parent_post_id string"
    posts = spark.createDataFrame([("p", None)], schema)
    comments = spark.createDataFrame([("c1", "p"), ("c2", "q")], schema)
    found = threads.with_kind(threads.batch_of(posts, comments)).collect()
    assert {(r.post_id, r.kind) for r in found} == {("p", "post"), ("c1", "comment")}


def test_bin_widths_by_hand():
    from decimal import Decimal

    wanted = {
        (-1.0, 1.0, 30): "0.1", (0.0, 0.0, 30): "1", (5.5, 5.5, 30): "1", (0.0, 2.9, 30): "0.1", (0.0, 3.0, 30): "0.2",
        (-0.4, -0.1, 30): "0.02", (0.0, 29.0, 30): "1", (0.0, 30.0, 30): "2", (-7.0, 1000.0, 30): "50", (1.0, 2.0, 1): "5",
        (0.3, 0.6, 4): "0.1", (0.0, 1e9, 30): "50000000", (0.0, 1e-6, 30): "5E-8", (-5.0, 5.0, 2): "5",
    }
    wanted.pop((-5.0, 5.0, 2))  # three bins of 5; ever wider ones meet the zero
    for (least, most, bins), width in wanted.items():
        assert reports.bin_width(least, most, bins) == Decimal(width), (least, most, bins)


def test_auto_histogram_by_hand(spark):
    def bins(*values, most=30):
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        return [tuple(r) for r in reports.auto_histogram(rows, "x", most).orderBy("bin_start").collect()]

    assert bins(0.3, 0.6, None, float("nan"), 0.35, 0.4, most=4) == [(0.3, 0.4, 2), (0.4, 0.5, 1), (0.5, 0.6, 0), (0.6, 0.7, 1)]
    assert bins(2.5, 2.5) == [(2.0, 3.0, 2)]
    assert bins(-0.4, -0.1, most=5) == [(-0.4, -0.3, 1), (-0.3, -0.2, 0), (-0.2, -0.1, 0), (-0.1, 0.0, 1)]
    thirty = bins(*map(float, range(30)))
    assert thirty == [(float(i), i + 1.0, 1) for i in range(30)]
    assert bins() == bins(None) == []


def test_sketches_add_up(spark):
    """Several days, names that return, and many names: within four standard errors of the exact count."""
    from datetime import date, timedelta

    from tallyvox.operators import sketches

    rows = spark.range(60_000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("date"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("land "), (F.col("id") % 40_000).cast("string"), F.lit(", uk,,US"))).alias("country"),
        F.when(F.col("id") % 2 == 0, "Putin,Xi").otherwise("").alias("leader"),
        F.lit(0.5).alias("sentiment_score"),
        F.when(F.col("id") % 2 == 0, 4).alias("upvotes"),
    )
    path = fresh_dir(spark, "sketches")
    sketches.daily_sketches(rows).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 5
    for first, days in ((0, 5), (1, 2), (4, 1), (9, 1)):
        start = date(2024, 1, 1) + timedelta(first)
        got = sketches.headline_between(stored, start, start + timedelta(days - 1)).first()
        ids = [i for i in range(60_000) if first <= i % 5 < first + days]
        exact = len({i % 40_000 for i in ids if i % 3 == 0}) + 2 * bool(ids)
        assert got.total_posts == len(ids) and got.leaders == 2 * bool(ids)
        assert abs(got.countries - exact) <= 4 * 1.04 / 64 * exact
        assert (got.avg_sentiment, got.avg_upvotes) == ((0.5, 4.0) if ids else (None, None))
