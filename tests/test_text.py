import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyvox.functions import scores, text, times


def apply(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def python_clean(value):
    """Links up to the next white space, then names and tags, then outer white space."""
    without_links = re.sub(r"(http|www)\S+", "", value)
    return re.sub(r"[@#]\w+", "", without_links).strip()


CASES = [
    "see http://a.b/c and @José #naïve now",
    "https://x.y www.z.com/a?b=c plain",
    "  \t\n 　 both ends  \x1c ",
    "",
    "   ",
    "#",
    "@ user a@b.c",
    "wwwhat http",
    "mid dle http://a b",
    "#été_2024!@x-y",
]


def test_clean_matches_python(spark):
    assert apply(spark, CASES, text.clean_text) == [python_clean(c) for c in CASES]


def test_clean_fixture(spark):
    assert apply(spark, [CASES[0]], text.clean_text) == ["see  and   now"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.lists(
            st.sampled_from(["http://é", "www", "@a", "#ß_1", " ", " ", "\n", "x!", "\x1f", "É", "-"]),
            max_size=8,
        ).map("".join),
        min_size=1,
        max_size=40,
    )
)
def test_clean_and_strip_property(spark, values):
    assert apply(spark, values, text.clean_text) == [python_clean(v) for v in values]
    assert apply(spark, values, text.strip) == [v.strip() for v in values]
    assert apply(spark, values, text.is_blank) == [not v.strip() for v in values]


def test_title_case_matches_python(spark):
    values = ["PEOPLE'S PARTY", "x-y z", "ÉTATS unis", "a1b", "", "north korea"]
    assert apply(spark, values, text.title_case) == [v.title() for v in values]


def test_long_runs_stay_quick(spark):
    value = "=" * 200_000 + " x " + " " * 200_000 + "!" * 200_000 + " end"
    assert len(apply(spark, [value], text.clean_text)[0]) == len(value)
    assert apply(spark, [value], text.opinion_tokens) == [["end"]]
    assert apply(spark, [value], text.word_tokens) == [["x", "end"]]


def test_opinion_tokens(spark):
    found = apply(spark, ["(Hello) -- it's a  'GOOD' day!!", None, ""], text.opinion_tokens)
    assert found == [["Hello", "it's", "GOOD", "day"], None, []]


def test_body_or_title(spark):
    rows = spark.createDataFrame(
        [("", "t"), (None, "t"), (" ", "t"), (None, None), ("b", "t")], "b string, t string"
    )
    found = [r[0] for r in rows.select(text.body_or_title(F.col("b"), F.col("t"))).collect()]
    assert found == ["t", "t", " ", None, "b"]


def test_clip_and_bins(spark):
    rows = spark.createDataFrame([(-3.0,), (0.5,), (7.0,), (None,)], "v double")
    clipped = scores.clip_score(F.col("v"))
    assert [r[0] for r in rows.select(clipped).collect()] == [-1.0, 0.5, 1.0, None]
    assert [r[0] for r in rows.select(scores.histogram_bin(clipped, 30)).collect()] == [0, 22, 29, None]


def test_times(spark):
    row = spark.sql(
        "SELECT timestamp'2024-01-07 23:30:00' AS sunday, '2024-01-01T00:00:00+00:00' AS iso"
    ).select(
        times.day_of_week(F.col("sunday")),
        times.hour_of_day(F.col("sunday")),
        times.epoch_to_ts(F.lit(1704067200.5)).cast("string"),
        times.is_expired(F.col("iso"), F.lit(60), F.expr("timestamp'2024-01-01 00:01:00'")),
        times.is_expired(F.col("iso"), F.lit(60), F.expr("timestamp'2024-01-01 00:01:01'")),
        times.is_expired(F.lit("no time"), F.lit(60), F.expr("timestamp'2024-01-01'")),
    ).first()
    assert tuple(row) == (0, 23, "2024-01-01 00:00:00.5", False, True, None)


def test_display(spark):
    row = spark.range(1).select(
        scores.show_score(F.lit(0.456)),
        scores.show_count(F.lit(1234567)),
        scores.show_time(F.expr("timestamp'2024-01-07 23:30:59'")),
    ).first()
    assert tuple(row) == ("0.46", "1,234,567", "2024-01-07 23:30")
