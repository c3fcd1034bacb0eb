"""Parameters the registered queries use on the given tables: the words below occur there."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.operators.language import LanguageModel, text_fold, train_profile
from tallyvox.operators.lookup import inline_frame
from tallyvox.operators.sentiment import SentimentModel
from tallyvox.plans.adapters import table
from tallyvox.session import discard, fresh_dir

LANGUAGES = ("de", "en", "es", "fr")
PROFILE_SIZE = 100
LARGE_PROFILE = 2000  # words of each language
RANKED_GROUPS, RANKED_IN_TEXT = 1500, 300
TRAIN_FOLDS = 8  # folds 0-7 of 16 train, the others test

KEYWORDS = [("the", "EN"), ("der", "DE"), ("les", "FR"), ("los", "ES"), ("uk", "GB")]
LEADER_WORDS = [("ertion", "Ertion"), ("heit", "Heit"), ("ment", "Ment"), ("dos", "Dos")]
PHRASES = [
    ("the", "EN"),
    ("of the", "EN-OF"),
    ("in the", "EN-IN"),
    ("to be", "EN-BE"),
    ("der", "DE"),
    ("in der", "DE-IN"),
    ("les", "FR"),
    ("de la", "FR-LA"),
    ("los", "ES"),
    ("uk", "GB"),
]
# Names with the code they should get, by hand (None: no code).
COUNTRY_NAMES = [
    ("Oman", "OMN"), ("Niger", "NER"), ("Nigeria", "NGA"), ("Romania", "ROU"), ("Bolivia", "BOL"),
    ("Ghana", "GHA"), ("Libya", "LBY"), ("Algeria", "DZA"), ("Nepal", "NPL"), ("Ecuador", "ECU"),
    ("Mali", "MLI"), ("Man", "IMN"), ("Ira", None), ("Iran", "IRN"), ("Gemany", "DEU"), ("Atlantis", None),
    ("korea", "PRK"), ("Lanka", "LKA"), ("USA", "USA"), ("European Union", "EUR"),
]
# Put before the documents' texts, in turn.
LEADING_PHRASES = [
    "Leaders of the Democratic People's Republic of Korea met",
    "In Congo, Joe Biden",
    "President Putin of Russia and Xi",
    "",
]

TINY_LANGUAGES = LanguageModel(("de", "en"), {"click": (-9, -1), "turn": (-1, -9)})

RULE_MODEL = SentimentModel(
    lexicon={
        "thing": 1.3,
        "thtion": -0.9,
        "ertion": 2.1,
        "erble": -1.7,
        "attion": 0.8,
        "der": 0.4,
        "les": -0.6,
        "los": 0.5,
        "best": 3.2,
        "idiot": -2.3,
        "scum": -2.6,
        "stupid": -2.4,
        "trash": -1.9,
        "vile": -2.9,
    },
    boosters={"and": 0.293, "that": -0.293, "und": 0.293, "et": -0.293},
    negators=("of", "nicht", "que"),
    pivot="with",
)



def with_phrases(posts: DataFrame) -> DataFrame:
    number = F.pmod(F.col("post_id").cast("bigint"), F.lit(len(LEADING_PHRASES)))
    phrase = F.get(F.array(*[F.lit(p) for p in LEADING_PHRASES]), number.cast("int"))
    return posts.withColumn("text", F.concat(phrase, F.lit(" "), "text"))


LOAD_TIME = datetime(2024, 2, 1, tzinfo=timezone.utc)
FIRST_DAY, LAST_DAY = date(2024, 1, 8), date(2024, 1, 17)
MARK = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)


def train_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("text", "lang")
    return documents.where(text_fold(F.col("text")) < TRAIN_FOLDS)


def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_profile(train_documents(spark, sf_dir), LANGUAGES, PROFILE_SIZE)


def large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings of the rule model among a word for every line item, which no text holds."""
    number = F.concat_ws("_", F.lit("item"), "l_orderkey", "l_linenumber")
    items = table(spark, sf_dir, "lineitem").select(number.alias("token"), F.lit(1.0).alias("valence"))
    return items.union(inline_frame(spark, list(RULE_MODEL.lexicon.items()), ["token", "valence"]))


def long_keywords(spark: SparkSession, sf_dir: str, listed: list[tuple[str, str]]) -> DataFrame:
    """A keyword for every part, and the given ones after them in their order."""
    number = F.concat_ws("_", F.lit("part"), "p_partkey")
    parts = table(spark, sf_dir, "part").select(F.lit(0).alias("priority"), number.alias("keyword"), F.lit("part").alias("value"))
    rows = [(i + 1, keyword, value) for i, (keyword, value) in enumerate(listed)]
    return parts.union(inline_frame(spark, rows, ["priority", "keyword", "value"]))


_SAVED: dict[tuple, str] = {}


def saved_profile(spark: SparkSession, sf_dir: str, size: int = PROFILE_SIZE) -> DataFrame:
    """The profile, trained once for each application and input and read again from then on."""
    known = (spark.sparkContext.applicationId, sf_dir, size)
    if known not in _SAVED:
        path, counts = fresh_dir(spark, "profile"), fresh_dir(spark, "gram-counts")
        documents = train_documents(spark, sf_dir)
        train_profile(documents, LANGUAGES, size, counts_path=counts).write.parquet(path)
        discard(spark, counts)
        _SAVED[known] = path
    path = _SAVED[known]
    return spark.read.schema("gram string, lang string, n bigint, log_p bigint").parquet(path)


def language_model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    return LanguageModel.from_profile(saved_profile(spark, sf_dir))
