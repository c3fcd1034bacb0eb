"""What depends on a text alone, found once for each different text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGEST = "_digest"


def per_text(posts: DataFrame, find: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """Add the columns that `find` returns beside the digest for a table (digest, text) of the
    different texts. Posts that share a text, or a key, keep their rows; a null text counts as empty."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    marked = posts.withColumn(DIGEST, digest)
    once = marked.groupBy(DIGEST).agg(F.max(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    found = find(once)
    replaced = [c for c in found.columns if c != DIGEST and c in posts.columns]
    return marked.drop(*replaced).join(found, DIGEST, "left").drop(DIGEST)
