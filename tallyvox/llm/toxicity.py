"""Toxicity by a counterfactually regularised linear classifier.

Features are the hashed runs of five and six bytes a text contains (case and punctuation folded).
The classifier is logistic; beside the usual loss it pays for every change of its logit when the
identity terms of a labelled sentence are swapped for others, so that naming a group does not move
a score. Sentences without such a term get one in the place of a word, and another in the same
place. The model is fitted on at most `MAX_LABELLED` labelled rows, taken by a hash of their id;
all other work covers every row and the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.common import as_row, by_bytes, parts, stored

MAX_LABELLED = 20_000
HASH_BITS = 20
FEATURES = 2048
BLOCK = 1 << 18
BATCH_CHARS = 1 << 19
FOLDS = 5

# Neutral words for groups of people, by kind and language (en, de, es, fr). A term is
# swapped within its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("black", "white", "asian", "african", "european", "latino", "indigenous"),
    ("americans", "mexicans", "chinese", "russians", "germans", "nigerians", "indians"),
    ("immigrants", "refugees", "foreigners", "locals", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen", "mütter", "väter"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwule", "lesben", "bisexuelle"),
    ("türken", "russen", "polen", "franzosen", "deutsche"),
    ("ausländer", "flüchtlinge", "einheimische", "bürger"),
    ("mujeres", "hombres", "niñas", "niños", "madres", "padres"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("gais", "lesbianas", "bisexuales"),
    ("mexicanos", "rusos", "chinos", "alemanes", "españoles"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("femmes", "hommes", "filles", "garçons", "mères", "pères"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("gays", "lesbiennes", "bisexuels"),
    ("russes", "chinois", "allemands", "algériens", "français"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
)
KIND = {term: kind for kind, terms in enumerate(IDENTITY_TERMS) for term in terms}
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
# ASCII punctuation and white space become blanks.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    """Sorted feature numbers with a weight each, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << HASH_BITS, np.float32)
        dense[self.features] = self.weights
        return dense


# --- features --------------------------------------------------------------------------------


def _buffer(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, folded, in one array of bytes, and where each begins. A blank stands before and
    six stand after a text, so that every place of it begins a run."""
    parts = [
        b" " + (t or "").lower().encode("utf-8", "replace").translate(FOLD) + b"      " for t in texts
    ]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    return np.frombuffer(b"".join(parts), np.uint8), starts


def _runs(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, feature numbers) for blocks of places, five bytes and six bytes in turn."""
    last = len(codes) - 5
    for first in range(0, last, BLOCK):
        n = min(BLOCK, last - first)
        wide = codes[first : first + n + 5].astype(np.uint64)
        five = wide[:n].copy()
        for i in range(1, 5):
            five |= wide[i : i + n] << np.uint64(8 * i)
        six = five | (wide[5 : 5 + n] << np.uint64(40)) | np.uint64(1 << 48)
        for packed in (five, six):
            mixed = packed * np.uint64(0x9E3779B97F4A7C15)
            yield first, (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def present(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, sorted, each once; only those `wanted` (a mask), if given."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, starts = _buffer(texts)
    ends, found = np.append(starts[1:], len(codes)), []
    for first, features in _runs(codes):
        places = np.arange(len(features)) if wanted is None else np.flatnonzero(wanted[features])
        text = np.searchsorted(starts, places + first, side="right") - 1
        whole = places + first + 6 <= ends[text]  # no run reaches into the next text
        found.append(np.unique((text[whole] << HASH_BITS) | features[places[whole]]))
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


# --- counterfactual sentences ----------------------------------------------------------------


def _pick(text: str, n: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % n


def swapped(sentence: str) -> str:
    """The sentence with every identity term replaced by the next but `k` of its kind."""

    def other(match: re.Match) -> str:
        kind = KIND.get(match[0].lower())
        if kind is None:
            return match[0]
        terms = IDENTITY_TERMS[kind]
        step = 1 + _pick(sentence, len(terms) - 1)
        return terms[(terms.index(match[0].lower()) + step) % len(terms)]

    return WORD.sub(other, sentence)


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """Pairs of sentences that ought to score alike: of every sentence with an identity term, or of
    one that is given a term where there is none."""
    sentences = [s for s in SENTENCE.findall(text) if s.strip()]
    named = [s for s in sentences if any(w in KIND for w in WORD.findall(s.lower()))]
    pairs = [(s, swapped(s)) for s in named]
    if not pairs and sentences:
        plain = sentences[_pick(text, len(sentences))]
        words = plain.split()
        terms = IDENTITY_TERMS[_pick(plain, len(IDENTITY_TERMS))]
        at = _pick(plain[::-1], len(words))
        with_term = " ".join([*words[:at], terms[0], *words[at + 1 :]])
        pairs = [(with_term, swapped(with_term))]
    return pairs


# --- fitting ---------------------------------------------------------------------------------


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, limit: int) -> DataFrame:
    """(toxic, text) of at most `limit` labelled rows outside the held-out fold. A doubly
    labelled document counts as toxic if one label says so."""
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col("text"))
    return stored(
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
        .select("toxic", "text"),
        "toxicity-sample",
    )


def _informative(sample: DataFrame, count: int) -> np.ndarray:
    """The features whose share of toxic and other texts differs most, in standard errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in parts(batches):
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            first = 0
            for texts in by_bytes((t or "" for t in batch.column(1).to_pylist()), BATCH_CHARS):
                text, feature = present(texts)
                for label in (0, 1):
                    mine = toxic[first + text] == label
                    seen[label] += np.bincount(feature[mine], minlength=1 << HASH_BITS)
                first += len(texts)
        some = np.flatnonzero(seen.any(axis=0))
        for part in np.array_split(some, 1 + len(some) // 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(seen[0, part]), pa.array(seen[1, part])],
                names=["feature", "clean", "toxic"],
            )

    totals = sample.groupBy().agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    bad, good = totals.bad or 0, totals.n - (totals.bad or 0)
    counted = (
        sample.mapInArrow(run, "feature long, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    both = (F.col("clean") + F.col("toxic") + 1) / (good + bad + 2)
    gap = (F.col("toxic") + 0.5) / (bad + 1) - (F.col("clean") + 0.5) / (good + 1)
    score = F.abs(gap) / F.sqrt(both * (1 - both) * (1 / (bad + 1) + 1 / (good + 1)))
    best = counted.where("clean + toxic >= 2").orderBy(score.desc(), "feature").limit(count)
    return np.sort(np.array([row.feature for row in best.select("feature").collect()], np.int64))


def _examples(sample: DataFrame, features: np.ndarray) -> tuple[list, list, list, list]:
    """Labels, the features of each text, the signed feature changes of each swap, all by position in
    `features`, and the weights of the swaps: one over their number in the text, so that long texts
    count no more. As many rows as the sample has texts and sentences with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << HASH_BITS, bool)
        wanted[features] = True

        def lists(texts: list[str]) -> list[np.ndarray]:
            text, feature = present(texts, wanted)
            cuts = np.searchsorted(text, np.arange(1, len(texts)))
            return np.split(np.searchsorted(features, feature), cuts)

        for batch in parts(batches):
            toxic, first = batch.column(0).to_pylist(), 0
            for texts in by_bytes((t or "" for t in batch.column(1).to_pylist()), BATCH_CHARS):
                found = [counterfactuals(t) for t in texts]
                pairs = [pair for of_text in found for pair in of_text]
                shares = [1 / len(of_text) for of_text in found for _ in of_text]
                before, after = lists([a for a, _ in pairs]), lists([b for _, b in pairs])
                changes = [
                    np.concatenate([np.setdiff1d(a, b), ~np.setdiff1d(b, a)]).astype(np.int64)
                    for a, b in zip(before, after)
                ]
                rows = [(toxic[first + i], x.tolist(), 1.0) for i, x in enumerate(lists(texts))]
                rows += [(-1, change.tolist(), share) for change, share in zip(changes, shares) if len(change)]
                first += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.list_(pa.int64()), pa.float64()))],
                    names=["toxic", "features", "share"],
                )

    rows = sample.mapInArrow(run, "toxic int, features array<long>, share double").toArrow()
    found = [*zip(*(rows.column(name).to_pylist() for name in ("toxic", "features", "share")))]
    texts, swaps = [r for r in found if r[0] >= 0], [r for r in found if r[0] < 0]
    return [y for y, _, _ in texts], [x for _, x, _ in texts], [x for _, x, _ in swaps], [w for _, _, w in swaps]


def _rows(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: columns, signs, row numbers. `~i` is column i with a minus."""
    flat = np.array([i for x in lists for i in x], np.int64)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return np.where(flat < 0, ~flat, flat), np.where(flat < 0, -1.0, 1.0), row


class Loss:
    """The log loss + `penalty` x the mean squared change of the logit under a swap (by the swaps'
    `shares`) + `ridge` x the squared weights. Toxic texts are rare, so they weigh as much more as
    the square root of their rarity. The last value is the bias."""

    def __init__(self, labels, texts, swaps, size: int, penalty: float, ridge: float, shares=None):
        self.y, self.size, self.penalty, self.ridge = np.array(labels, float), size, penalty, ridge
        n, bad = max(1, len(labels)), self.y.sum()
        share = np.where(self.y > 0, np.sqrt(max(1.0, (n - bad) / max(1.0, bad))), 1.0)
        self.share, self.start = share / share.sum(), np.log((bad + 0.5) / (n - bad + 0.5))
        self.col, _, self.row = _rows(texts)
        self.swap_col, self.sign, self.swap_row = _rows(swaps)
        self.swaps = np.array(shares if shares is not None else [1.0] * len(swaps), float)
        self.swaps = self.swaps / max(self.swaps.sum(), 1e-12)

    def __call__(self, value: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss and its slope."""
        logit = np.bincount(self.row, value[self.col], minlength=len(self.y)) + value[self.size]
        logit = np.clip(logit, -40, 40)
        error = self.share * (1 / (1 + np.exp(-logit)) - self.y)
        slope = np.append(np.bincount(self.col, error[self.row], minlength=self.size), error.sum())
        change = np.bincount(self.swap_row, self.sign * value[self.swap_col], minlength=len(self.swaps))
        pull = (self.sign * (self.swaps * change)[self.swap_row]) if len(self.swaps) else self.sign
        slope[:-1] += 2 * self.penalty * np.bincount(self.swap_col, pull, minlength=self.size)
        slope[:-1] += 2 * self.ridge * value[:-1]
        loss = (self.share * (np.logaddexp(0, logit) - self.y * logit)).sum()
        loss += self.penalty * (self.swaps * change**2).sum() + self.ridge * (value[:-1] ** 2).sum()
        return float(loss), slope


def optimise(
    labels: list[int],
    texts: list[list[int]],
    swaps: list[list[int]],
    size: int,
    penalty: float,
    shares: list[float] | None = None,
    ridge: float = 1e-4,
    steps: int = 300,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise `Loss` (Adam on the full sample)."""
    loss = Loss(labels, texts, swaps, size, penalty, ridge, shares)
    value, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    value[size] = loss.start
    for step in range(1, steps + 1):
        _, slope = loss(value)
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope**2
        value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return value[:size], float(value[size])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    max_labelled: int = MAX_LABELLED,
    penalty: float = 10.0,
) -> Model:
    """Fit on labelled documents (`docs` with key and text, `labels` with doc_id and toxic 0/1).
    Without labelled rows, or with one class only, every text scores the (smoothed) base rate."""
    sample = labelled_sample(docs, labels, key, max_labelled)
    features = _informative(sample, FEATURES)
    toxic, texts, swaps, shares = _examples(sample, features)
    if not 0 < sum(toxic) < len(toxic):
        rate = (sum(toxic) + 0.5) / (len(toxic) + 1) if toxic else 0.25
        return Model(features[:0], np.empty(0), float(np.log(rate / (1 - rate))))
    weights, bias = optimise(toxic, texts, swaps, len(features), penalty, shares)
    return Model(features, weights, bias)


# --- scoring ---------------------------------------------------------------------------------


def score_texts(model: Model, texts: list[str | None], dense: np.ndarray | None = None) -> np.ndarray:
    dense = model.table() if dense is None else dense
    text, feature = present(texts, dense != 0)
    logit = np.bincount(text, dense[feature], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row as (row, score): the whole input row and its score from 0 to 1. Null and empty
    texts get the score of a text without features. An empty table gives an empty result."""

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = model.table()
        for column in columns:
            scores = [
                score_texts(model, texts, dense)
                for texts in by_bytes((t.as_py() or "" for t in column), BATCH_CHARS)
            ]
            yield pa.array(np.concatenate(scores) if scores else [], pa.float64())

    # Only the text goes to the worker and only the score comes back.
    return docs.select(as_row(docs), score(F.col(f"`{text}`")).alias("score"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, held_out (never fitted on), score, predicted (1: toxic).

    Repeated rows and rows that share a key are scored each, by their text alone; equal texts have
    equal scores. Null and empty texts score as texts without features. A null key is not held
    out. Of several texts with a labelled key, the smallest is fitted on. An empty table gives an
    empty result.
    """
    model = fit(docs, labels, key, **options)
    id_ = F.col(f"row.`{key}`")
    return scored(docs.select(f"`{key}`", "text"), model).select(
        id_.alias(key),
        F.coalesce(held_out(id_), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows that score below 0.5, with the columns of the input."""
    return scored(docs, fit(docs, labels, key, **options)).where("score < 0.5").select("row.*")
