"""SentencePiece models run by the tokenizers library.

The model file is a protobuf message; its wire format is read here field by field. From it come
the normaliser, the marker for blanks, the pieces with their scores and the byte pieces. A unigram
model takes the scores as they are; a byte-pair model takes its merges in the order of the scores.
Every text's ids can be compared with those of the sentencepiece library.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyvox.llm.common import by_bytes, parts
from tallyvox.llm.units import Joint, Units

BATCH_CHARS = 1 << 20
THREADS = 2
MARK = "▁"  # stands for a blank

# Kinds of pieces and of models, by number, in the message.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


# --- the message -----------------------------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: whole numbers, or the bytes of everything else."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"unknown wire type {kind}")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """What of the message matters here."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # piece, score, kind
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_blanks: bool = True
    escape_blanks: bool = True


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_blanks = bool(v)
                elif n == 5:
                    model.escape_blanks = bool(v)
    return model


# --- the tokenizer ---------------------------------------------------------------------------


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two pieces, the best-scored piece first."""
    usable = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind != NORMAL:
            continue
        for cut in range(1, len(piece)):
            left, right = usable.get(piece[:cut]), usable.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-score, usable[piece], left, right, piece[:cut], piece[cut:]))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: Model, prefix: bool = True):
    """The tokenizer of a model; without `prefix` the caller puts the first blank."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocabulary = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        scored = [(piece, score) for piece, score, _ in model.pieces]
        backend = models.Unigram(scored, unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        backend = models.BPE(
            vocab=vocabulary,
            merges=merges(model),
            unk_token=None if unknown is None else model.pieces[unknown][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError("only unigram and byte-pair models")
    tokenizer = Tokenizer(backend)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_blanks:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(parts)
    return tokenizer


def _ids(ids: np.ndarray) -> bytes:
    return ids.tobytes()


class Backend:
    """Encoder and decoder of one model file.

    Where texts are not normalised and no piece holds a blank after another character, a text's
    ids are those of its words with the blanks before them, so repeated words are encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        with open(path, "rb") as file:
            self.model = parse_model(file.read())
        # A byte piece below 128 is a character by itself; the others need their neighbours.
        ascii_bytes = {f"<0x{b:02X}>": chr(b) for b in range(128)}
        kinds = [kind for _, _, kind in self.model.pieces]
        self.pieces = [ascii_bytes.get(p, p) if k == BYTE else p for p, _, k in self.model.pieces]
        self.plain = np.array(
            [k in (NORMAL, USER_DEFINED) or (k == BYTE and len(p) == 1) for k, p in zip(kinds, self.pieces)]
        )
        self.by_words = (
            self.model.kind == BPE
            and not self.model.charsmap
            and not self.model.remove_extra_blanks
            and self.model.escape_blanks
            and not any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _, _ in self.model.pieces)
        )
        # One tokenizer serves both ways; where words are encoded apart, it puts no first blank.
        self.tokenizer = build(self.model, prefix=not self.by_words)
        split = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+").findall if self.by_words else None
        self.units = Units(self.tokenizer, split, _ids, self._joint() if self.by_words else None)

    def _joint(self) -> Joint:
        """A word with one blank before it begins with the only piece of it that has the mark."""
        borders = np.array([piece.startswith(MARK) for piece in self.pieces])
        return Joint("", lambda unit: unit[0] == " " and unit[1:2] not in ("", " ", MARK), borders, False, ())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without begin and end."""
        if self.by_words and self.model.dummy_prefix:
            texts = [" " + t if t else t for t in texts]
        return [b"".join(parts) for parts in self.units(texts)]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Plain pieces are joined from the table; texts with other pieces go through the library's
        decoder."""
        arrays = [np.frombuffer(x, "<u4") for x in ids]
        plain = [bool(self.plain[a].all()) for a in arrays]
        rest = [a.tolist() for a, p in zip(arrays, plain) if not p]
        decoded = iter(self.tokenizer.decode_batch(rest, skip_special_tokens=False) if rest else [])
        first = int(self.model.dummy_prefix)
        return [self._joined(a, first) if p else next(decoded) for a, p in zip(arrays, plain)]

    def _joined(self, ids: np.ndarray, first: int) -> str:
        text = "".join(map(self.pieces.__getitem__, ids.tolist())).replace(MARK, " ")
        return text[first:] if text.startswith(" ") else text


@cache
def backend(path: str) -> Backend:
    return Backend(path)


@cache
def library(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


# --- tables ----------------------------------------------------------------------------------


def encode(
    docs: DataFrame, path: str, text: str = "text", verify: bool = True, decoded: bool = False
) -> DataFrame:
    """The columns of `docs` in `row`, with `ids` (little-endian unsigned 32-bit) and `parity`:
    are they the sentencepiece library's ids (null unless `verify`)? With `decoded`, also the text
    that the ids give, from the same worker.

    `path` is the model file as every executor finds it. A null or empty text has no ids. An empty
    table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = backend(path)
        for batch in parts(batches):
            ids, same, texts_again = [], [], []
            for texts in by_bytes((t or "" for t in batch.column(1).to_pylist()), BATCH_CHARS):
                found = coder.encode(texts)
                ids += found
                if verify:
                    wanted = library(path).encode(texts, num_threads=1)
                    same += [np.array(w, "<u4").tobytes() == f for w, f in zip(wanted, found)]
                else:
                    same += [None] * len(texts)
                if decoded:
                    texts_again += coder.decode(found)
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())]
            columns += [pa.array(texts_again, pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = StructType(list(rows.select("row").schema.fields))
    schema = schema.add("ids", "binary").add("parity", "boolean")
    schema = schema.add("decoded", "string") if decoded else schema
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with the text of its `ids` as `decoded`; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = backend(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            texts = coder.decode([x or b"" for x in ids])
            decoded = [None if x is None else t for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    return encoded.mapInArrow(run, StructType(list(encoded.schema.fields)).add("decoded", "string"))
