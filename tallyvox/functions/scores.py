"""Score and display columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_score(score: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Bound a score; null stays null (greatest and least alone would skip it)."""
    return F.when(score.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), score)))


def histogram_bin(score: Column, bins: int, low: float = -1.0, high: float = 1.0) -> Column:
    """Number of the equal-width bin, 0 to bins-1; the upper bound falls in the last bin."""
    raw = F.floor((score - F.lit(low)) * F.lit(bins / (high - low)))
    return F.when(score.isNotNull(), F.least(F.lit(bins - 1), F.greatest(F.lit(0), raw.cast("int"))))


def show_score(score: Column) -> Column:
    return F.format_number(score, 2)


def show_count(count: Column) -> Column:
    return F.format_number(count, 0)


def show_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")
