"""Encoding by units: long texts split at safe boundaries, repeated units encoded once.

A unit is a run of white space with the run of other characters after it. The byte-pair tokenizers
that `Units` accepts cut every text into pre-tokens by a pattern first; none of their pre-tokens
holds a white space after another character, and none looks back over such a border. So the ids of
a text are those of its units in a row. Where white space itself gives no ids, units are words.

The four ASCII separators are white space here and not there: texts with one are encoded whole. A
text without white space is one unit, whatever its length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyvox.llm.common import by_bytes, one_thread

MEMO_ENTRIES = 250_000  # in each of two generations: at most about 110 MB for each worker
MEMO_CHARS = 64  # longer units are encoded each time
JOINT_CHARS = 1 << 14
MARKS = (".", ",")
TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe, which begins pre-tokens
BLANK = "Ġ"  # stands for a blank in byte-level vocabularies
SEPARATORS = re.compile("[\x1c-\x1f]").search
SPACED = re.compile(r"\s*\S+|\s+").findall


def splitter(spec: dict) -> Callable[[str], list[str]] | None:
    """How a tokenizer's texts may be cut, or None if it is of another kind."""
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if spec["model"]["type"] != "BPE" or any(
        t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]
    ):
        return None
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not normal:
        return SPACED
    steps = pre.get("pretokenizers", [])
    local = {"NFC", "Lowercase", "Replace"}  # a character and its neighbours, never over white space
    if (
        [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["behavior"] == "Removed"
        and steps[0]["invert"]
        and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and {n["type"] for n in normal.get("normalizers", [])} <= local
    ):
        return str.split
    return None


@dataclass(frozen=True)
class Joint:
    """How simple units (letters only, in the splitter's form) are encoded many at a time: joined
    by `glue`, and told apart by the tokens that begin, or end, a pre-token."""

    glue: str
    simple: Callable[[str], bool]
    borders: np.ndarray  # by id
    ends: bool  # the borders end a unit, and do not begin it
    marks: tuple[str, ...] = MARKS  # after letters, a pre-token of their own

    def cuts(self, ids: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.borders[ids])
        return np.concatenate([[0], at + 1]) if self.ends else np.append(at, len(ids))


def letters(text: str) -> bool:
    """Letters only, also when normalised: some letters become a letter and a mark."""
    if text.isascii():
        return text.isalpha()
    return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


def joint(spec: dict, split: Callable | None) -> Joint | None:
    vocabulary = spec["model"]["vocab"]
    suffix = spec["model"].get("end_of_word_suffix")
    borders = np.zeros(1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]), bool)
    if split is str.split and suffix:
        borders[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return Joint(" ", letters, borders, True)
    if split is SPACED:
        borders[[i for token, i in vocabulary.items() if token.startswith(BLANK)]] = True
        return Joint("", lambda unit: unit[0] == " " and letters(unit[1:]), borders, False)
    return None


class Units:
    """Encode texts by `tokenizer`, cut by `split` (None: never); `value` makes what is kept of an
    array of ids (its length, its bytes), so that the values of two arrays add up."""

    def __init__(
        self,
        tokenizer,
        split: Callable | None,
        value: Callable,
        joint: Joint | None = None,
        entries: int = MEMO_ENTRIES,
    ):
        self.tokenizer, self.split, self.value, self.joint = tokenizer, split, value, joint
        self.memo, self.older, self.entries = {}, {}, entries

    def encode(self, texts: list[str]) -> list:
        """The value of each text; batches of equal size in characters."""
        return [
            self.value(np.array(found.ids, "<u4"))
            for batch in by_bytes(texts)
            for found in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        ]

    def encode_joint(self, units: list[str], tokenizer=None) -> list:
        """The value of each simple unit. If the tokens do not tell as many units apart (a letter
        may fall into several when it is normalised), each is encoded by itself."""
        values, tokenizer = [], tokenizer or self.tokenizer
        for part in by_bytes(units, JOINT_CHARS):
            found = tokenizer.encode_batch_fast([self.joint.glue.join(part)], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            cuts = self.joint.cuts(ids)
            if len(cuts) == len(part) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
                bounds = cuts.tolist()
                values += [self.value(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
            else:
                values += self.encode(part)
        return values

    def learn(self, missing: list[str]) -> dict[str, object]:
        """The values of units. A full stop or comma after letters is a pre-token of its own."""
        if self.joint is None:
            return dict(zip(missing, self.encode(missing)))
        simple, marked, others = [], [], []
        for unit in missing:
            if len(unit) > 1 and unit[-1] in self.joint.marks and self.joint.simple(unit[:-1]):
                marked.append(unit)
            else:
                (simple if self.joint.simple(unit) else others).append(unit)
        bases = list({unit[:-1] for unit in marked}.difference(self.memo, simple))
        found = dict(zip(simple + bases, self.encode_joint(simple + bases)))
        found.update(zip(others, self.encode(others)))
        marks = dict(zip(MARKS, self.encode(list(MARKS)))) if marked else {}
        for unit in marked:
            base = unit[:-1]
            found[unit] = (found[base] if base in found else self.memo[base]) + marks[unit[-1]]
        return found

    def __call__(self, texts: list[str]) -> list[list]:
        """For each text the values of its units, in their order."""
        cut = [[t] if self.split is None or SEPARATORS(t) else self.split(t) for t in texts]
        if len(self.memo) > self.entries:  # what is used again comes back from the older half
            self.memo, self.older = {}, self.memo
        unseen = set().union(*cut).difference(self.memo)
        known = unseen.intersection(self.older)
        self.memo.update((unit, self.older[unit]) for unit in known)
        found = self.learn(list(unseen - known))
        long = {unit: found.pop(unit) for unit in [u for u in found if len(u) > MEMO_CHARS]}
        self.memo.update(found)
        if not long:
            return [list(map(self.memo.__getitem__, units)) for units in cut]
        return [[long[u] if u in long else self.memo[u] for u in units] for units in cut]


def plain(spec: dict) -> dict | None:
    """A tokenizer for lower-case ASCII letters apart by blanks: nothing to normalise, to cut by
    pattern, or to look for as a whole. None where an added token could stand in such a text."""
    if any(t["content"][:1].isalpha() for t in spec["added_tokens"]):
        return None
    blanks = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
    steps = [blanks, spec["pre_tokenizer"]["pretokenizers"][1]]
    pre = {"type": "Sequence", "pretokenizers": steps}
    return {**spec, "normalizer": None, "added_tokens": [], "pre_tokenizer": pre}


class WordIds(Units):
    """Ids of whole texts whose units are words. The memo is an Arrow array of words beside a table of
    ids; a batch is cut and its words are looked up by Arrow, only unseen words pass through Python, and
    the ids of all texts are gathered at once. Letters with a run of punctuation after them
    are two pre-tokens, each encoded once. `plain` encodes lower-case ASCII letters."""

    def __init__(self, tokenizer, split: Callable | None, joint: Joint, plain, entries: int = 2 * MEMO_ENTRIES):
        super().__init__(tokenizer, split, np.ndarray.tobytes, joint, entries)
        self.plain = plain
        self.clear()

    def clear(self) -> None:
        self.words, self.tails = pa.array([], pa.large_string()), {}
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def known(self, words: pa.Array) -> np.ndarray:
        """The number of each word in the table, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).copy()

    def encode_letters(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words of letters."""
        ascii_, other = [u for u in words if u.isascii()], [u for u in words if not u.isascii()]
        found = dict(zip(ascii_, self.encode_joint([u.lower() for u in ascii_], self.plain)))
        found.update(zip(other, self.encode_joint(other)))
        return found

    def learn(self, missing: list[str]) -> list[bytes]:
        """The ids of each unseen word."""
        simple, tailed, others = [], {}, []
        for word in missing:
            if letters(word):
                simple.append(word)
            elif letters(base := word.rstrip(TAILS)):
                tailed[word] = base, word[len(base) :]
            else:
                others.append(word)
        bases = list({base for base, _ in tailed.values()}.difference(simple))
        at = dict(zip(bases, self.known(pa.array(bases, pa.large_string())).tolist()))
        found = self.encode_letters(simple + [base for base in bases if at[base] < 0])
        found.update(
            (base, self.ids[self.ends[i] : self.ends[i + 1]].tobytes()) for base, i in at.items() if i >= 0
        )
        found.update(zip(others, self.encode(others)))
        tails = list({tail for _, tail in tailed.values()}.difference(self.tails))
        self.tails.update(zip(tails, self.encode(tails)))
        found.update((word, found[base] + self.tails[tail]) for word, (base, tail) in tailed.items())
        return [found[word] for word in missing]

    def add(self, words: pa.Array) -> None:
        if not len(words):
            return
        values = self.learn(words.to_pylist())
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(values), "<u4")])
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def drop_after(self, size: int) -> None:
        self.words, self.ends = self.words[:size], self.ends[: size + 1]
        self.ids = self.ids[: self.ends[-1]]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        apart = {i for i, t in enumerate(texts) if SEPARATORS(t)}
        if apart:
            found = iter(self.encode([t for i, t in enumerate(texts) if i in apart]))
            rest = [t for i, t in enumerate(texts) if i not in apart]
            cut = iter(self(rest) if rest else [])
            return [np.frombuffer(next(found), "<u4") if i in apart else next(cut) for i in range(len(texts))]
        if len(self.words) > self.entries:
            self.clear()
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = lists.values.dictionary_encode()
        words, size = numbered.dictionary, len(self.words)
        number = self.known(words)
        unseen = np.flatnonzero(number < 0)
        long = pc.greater(pc.utf8_length(words.take(pa.array(unseen))), MEMO_CHARS).to_numpy(zero_copy_only=False)
        for some in (unseen[~long], unseen[long]):
            number[some] = np.arange(len(self.words), len(self.words) + len(some))
            self.add(words.take(pa.array(some)))
        entry = number[numbered.indices.to_numpy(zero_copy_only=False)]
        first, sizes = self.ends[entry], self.ends[entry + 1] - self.ends[entry]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(first - stops[:-1], sizes) + np.arange(stops[-1])]
        self.drop_after(size + np.count_nonzero(~long))
        bounds = stops[lists.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


class WholeIds(Units):
    """Ids of whole texts that cannot be cut into words."""

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(found, "<u4") for found in self.encode(texts)]


@cache
def spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


@cache
def units(path: str, value: Callable | None) -> Units:
    """One for each worker process and tokenizer file: the memo lasts from task to task. Without
    `value`, one that gives the ids of whole texts."""
    one_thread()
    from tokenizers import Tokenizer

    split = splitter(spec(path))
    if value is None:
        how, fast = joint(spec(path), split), plain(spec(path)) if split is str.split else None
        if how is None or fast is None:
            return WholeIds(Tokenizer.from_file(path), None, np.ndarray.tobytes)
        return WordIds(Tokenizer.from_file(path), split, how, Tokenizer.from_str(json.dumps(fast)))
    return Units(Tokenizer.from_file(path), split, value, joint(spec(path), split))
