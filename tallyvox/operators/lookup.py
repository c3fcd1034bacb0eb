"""Lookup tables and the size check that decides how they are joined."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.functions.literals import literal

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(
    frame: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES
) -> bool:
    """Measure a frame with one aggregation: a row count and the bytes of its values. A limit
    would be no cheaper, as every task of a large frame would send its first rows to one task."""
    width = F.octet_length(F.to_json(F.struct("*")))
    found = frame.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
    ).first()
    return found.n <= rows and found.bytes <= size


def inline_frame(spark: SparkSession, rows: Iterable[Sequence], columns: Sequence[str]) -> DataFrame:
    """A small table from constants: a local relation, whose size the optimizer knows."""
    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


@dataclass(frozen=True)
class Dim:
    """A lookup table, with its row count where that is known from the start."""

    frame: DataFrame
    rows: int | None = None

    @classmethod
    def inline(cls, spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[str]) -> Dim:
        return cls(inline_frame(spark, rows, columns), len(rows))

    def is_small(self) -> bool:
        if self.rows is not None:
            return self.rows <= MAX_BROADCAST_ROWS
        return fits_broadcast(self.frame)

    def join_side(self) -> DataFrame:
        return F.broadcast(self.frame) if self.is_small() else self.frame
