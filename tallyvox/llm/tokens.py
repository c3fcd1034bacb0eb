"""Token counts: batches of even size are encoded in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.common import by_bytes, one_thread, parts
from tallyvox.llm.units import units

BATCH_CHARS = 2 << 20


def counts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text: `.json` by the tokenizers library, `.model` by sentencepiece. Special
    strings in a text are handled as the library does by default."""
    if path.endswith(".model"):
        return [len(ids) for ids in _pieces(path).encode(texts, num_threads=1)]
    return list(map(sum, units(path, len)(texts)))


def _pieces(path: str):
    one_thread()
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def token_counts(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512
) -> DataFrame:
    """One row per input row: key, n_bytes (UTF-8), n_tokens, over_limit (more than `limit`).

    `path` is the vocabulary file as every executor finds it. Null texts count as empty: no bytes,
    no tokens. Repeated rows each get their row. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = rows.select("id").schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, found = [t or "" for t in batch.column(1).to_pylist()], []
            for part in by_bytes(texts, BATCH_CHARS):
                found += counts(part, path)
            sizes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    return rows.mapInArrow(run, schema).select(
        F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
