"""Small helpers the corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.session import fresh_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write to a new folder below the shared root and read it again: cuts the lineage, and a lost
    executor costs no more than the stage that reads."""
    path = fresh_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def as_row(frame: DataFrame):
    """All columns as one struct, so that names a stage adds cannot clash with the caller's."""
    return F.struct(*[F.col(f"`{name}`") for name in frame.columns]).alias("row")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(texts: Iterable[str], limit: int = 4 << 20) -> Iterator[list[str]]:
    """Consecutive texts in batches of about `limit` characters."""
    batch, size = [], 0
    for text in texts:
        batch.append(text)
        size += len(text)
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


PART_BYTES = 4 << 20


def parts(batches: Iterable[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of about `PART_BYTES` of column `text`, so that a worker holds
    little beside the batch it was given, however long the texts are."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + PART_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """Spark runs a task per core; the libraries' own threads would fight over them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
