"""Keyed upsert and change-log folding.

A later copy of a record replaces only the mutable columns; all others keep the first value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.operators.lookup import fits_broadcast
from tallyvox.operators.quality import dedupe_posts
from tallyvox.schema import MUTABLE_COLUMNS, POST_KEY


def upsert(
    base: DataFrame,
    updates: DataFrame,
    key: str = POST_KEY,
    mutable: Sequence[str] = MUTABLE_COLUMNS,
    broadcast_updates: bool | None = None,
    unique_updates: bool = False,
) -> DataFrame:
    """Merge a batch into a table with unique keys; the batch is made unique first.

    A batch that fits a broadcast leaves the base where it is: it is scanned, not shuffled.
    A larger batch goes through one full outer join on the key.
    """
    updates = updates.select(*base.columns)
    if broadcast_updates is None:
        broadcast_updates = fits_broadcast(updates.select(key, *mutable))
    sent_keys = updates.select(key)
    if not unique_updates:
        updates = dedupe_posts(updates, key)
    fresh_values = updates.select(
        F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in mutable]
    )

    def merged(name: str):
        if name in mutable:
            return F.when(F.col("_hit"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
        return F.col(name)

    if broadcast_updates:
        kept = base.join(F.broadcast(fresh_values), key, "left").select(*map(merged, base.columns))
        seen = base.select(key).join(F.broadcast(sent_keys), key, "left_semi")
        # `seen` holds at most one row per update key, so it has the updates' bound.
        return kept.unionByName(updates.join(F.broadcast(seen), key, "left_anti"))

    old, new = base.alias("old"), updates.alias("new")
    in_old = F.col(f"old.{key}").isNotNull()
    in_new = F.col(f"new.{key}").isNotNull()

    def either(name: str):
        take_new = in_new if name in mutable else ~in_old
        return F.when(take_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    return joined.select(*map(either, base.columns))


def fold_log(
    log: DataFrame,
    seq: str,
    key: str = POST_KEY,
    mutable: Sequence[str] = MUTABLE_COLUMNS,
) -> DataFrame:
    """Current table from a log of copies ordered by `seq`, unique per (key, seq).

    Both ends of a key's history are found by one partial aggregation, so a key with very many
    copies sends one row per map task.
    """
    columns = [c for c in log.columns if c != seq]
    fixed_part = [c for c in columns if c != key and c not in mutable]
    first = F.min_by(F.struct(*fixed_part), seq).alias("_first")
    last = F.max_by(F.struct(*mutable), seq).alias("_last")
    picked = {c: F.col(f"_first.{c}") for c in fixed_part}
    picked.update({c: F.col(f"_last.{c}") for c in mutable})
    picked[key] = F.col(key)
    return log.groupBy(key).agg(first, last).select(*[picked[c].alias(c) for c in columns])
