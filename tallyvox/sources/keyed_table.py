"""The keyed post table: a log of batches, a folder per day, and the day of every key.

`log` holds a folder per stored batch, `days` one per day and rewrite, `keys` the day of every key.
`journal` is a list of one-row files, each appended after what it names has been written: batches
(stream, batch_id, path) and versions (no stream; the path of a manifest). A manifest names the
folder of every day, the folders of the keys, and the last batch of each stream that they contain.
So a reader never sees half of anything, and a key stays on the day of its first copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvox.operators.lookup import fits_broadcast
from tallyvox.operators.merge import fold_log, upsert
from tallyvox.operators.quality import dedupe_posts
from tallyvox.schema import PARTITION_COLUMN, POST_KEY, POST_SCHEMA
from tallyvox.session import discard, fresh_dir

JOURNAL = "seq bigint, stream string, batch_id bigint, path string"
MANIFEST = "kind string, name string, value string"
SEQ, DAY, BUCKET = "_seq", "_day", "_bucket"
KEY_BUCKETS = 16
MAX_KEY_FOLDERS = 16  # more are written as one


@dataclass(frozen=True)
class Version:
    """A published state."""

    days: dict[str, str]  # day: folder
    folded: dict[str, int]  # stream: last folded batch
    keys: tuple[str, ...] = ()  # folders


NOTHING = Version({}, {})


def _journal(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(JOURNAL).parquet(f"{root}/journal")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], JOURNAL)
        raise


def _note(spark: SparkSession, root: str, seq: int, stream: str | None, batch_id: int | None, path: str) -> None:
    row = spark.range(0, 1, 1, 1).select(F.lit(seq), F.lit(stream), F.lit(batch_id), F.lit(path))
    names = [field.split()[0] for field in JOURNAL.split(", ")]
    row.toDF(*names).to(spark.createDataFrame([], JOURNAL).schema).write.mode("append").parquet(f"{root}/journal")


def current_version(spark: SparkSession, root: str) -> Version | None:
    versions = _journal(spark, root).where("stream IS NULL")
    newest = versions.agg(F.max(F.struct("seq", "path")).alias("v")).first().v
    if not newest:
        return None
    found = spark.read.schema(MANIFEST).parquet(newest.path).collect()  # a row per day, stream, folder
    of = lambda kind: {r.name: r.value for r in found if r.kind == kind}
    return Version(of("day"), {k: int(v) for k, v in of("stream").items()}, tuple(of("keys")))


def _publish(spark: SparkSession, root: str, version: Version) -> None:
    rows = [("day", *day) for day in version.days.items()] + [("keys", path, None) for path in version.keys]
    rows += [("stream", stream, str(upto)) for stream, upto in version.folded.items()]
    manifest = f"{root}/manifests/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(manifest)
    seq = _journal(spark, root).where("stream IS NULL").count()
    _note(spark, root, seq, None, None, manifest)


def _write_parts(frame: DataFrame, path: str, by: str) -> DataFrame:
    """A folder for each value of `by`; what was written, read again."""
    frame.hint("rebalance", by).write.partitionBy(by).parquet(path)
    schema = T.StructType([f for f in frame.schema if f.name != by] + [T.StructField(by, T.StringType())])
    return frame.sparkSession.read.schema(schema).parquet(path)


def _write_days(frame: DataFrame, root: str) -> dict[str, str]:
    path = f"{root}/days/{uuid.uuid4().hex}"
    written = _write_parts(frame.withColumn(PARTITION_COLUMN, F.to_date("created_utc")), path, PARTITION_COLUMN)
    return {day: f"{path}/{PARTITION_COLUMN}={day}" for (day,) in written.select(PARTITION_COLUMN).distinct().collect()}


def _read_days(spark: SparkSession, days: Mapping[str, str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*days.values()) if days else spark.createDataFrame([], schema)


def _bucketed(keys: DataFrame) -> DataFrame:
    """(key, day) with the bucket of the key."""
    return keys.withColumn(BUCKET, F.pmod(F.xxhash64(keys.columns[0]), F.lit(KEY_BUCKETS)))


def _read_keys(spark: SparkSession, folders: Sequence[str], key: str) -> DataFrame:
    """(key, day, bucket) of all folders; a join on the bucket too reads only the updates' buckets."""
    schema = f"`{key}` string, {DAY} date, {BUCKET} bigint"
    parts = [spark.read.schema(schema).parquet(path) for path in folders]
    return reduce(DataFrame.union, parts, spark.createDataFrame([], schema))


def _located(updates: DataFrame, version: Version, key: str = POST_KEY) -> DataFrame:
    """Unique updates with the day that holds their key: null if none does. The lookup is scanned,
    not shuffled, if the updates' keys fit a broadcast."""
    sent = _bucketed(updates.select(key))
    keys = _read_keys(updates.sparkSession, version.keys, key)
    held = keys.join(F.broadcast(sent) if fits_broadcast(sent) else sent, [key, BUCKET]).select(key, DAY)
    return updates.join(held, key, "left")


def publish_snapshot(frame: DataFrame, root: str, version: int, stream: str = "snapshots") -> None:
    """Replace the whole table; keys are unique. A version of `stream` that is published, or older than one
    that is, is left alone, so repeating it changes nothing. Batches in the log that no version
    contains stay in force."""
    spark = frame.sparkSession
    folded = (current_version(spark, root) or NOTHING).folded
    if version <= folded.get(stream, -1):
        return
    days, path = _write_days(frame, root), f"{root}/keys/{uuid.uuid4().hex}"
    rows = _read_days(spark, days, frame.schema).select(POST_KEY, F.to_date("created_utc").alias(DAY))
    _write_parts(_bucketed(rows), path, BUCKET)
    _publish(spark, root, Version(days, {**folded, stream: version}, (path,)))


def write_log_batch(
    batch: DataFrame, root: str, batch_id: int, stream: str = "stream", key: str = POST_KEY
) -> None:
    """Store one batch of a stream, made unique by key. A batch that is stored already is left
    alone. Name each checkpoint's stream differently: batch ids count within a stream, and its
    batches come in their order. The order over all streams is that of the journal."""
    spark, mine = batch.sparkSession, (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
    batches = _journal(spark, root).where("stream IS NOT NULL")
    known = batches.agg(F.max("seq").alias("seq"), F.count_if(mine).alias("mine")).first()
    if not known.mine:
        seq, path = 0 if known.seq is None else known.seq + 1, f"{root}/log/{uuid.uuid4().hex}"
        dedupe_posts(batch, key).withColumn(SEQ, F.lit(seq).cast("bigint")).write.parquet(path)
        _note(spark, root, seq, stream, batch_id, path)


def _pending(spark: SparkSession, root: str, version: Version) -> list:
    """Complete batches that the version does not contain: as many as came since the last fold."""
    later = F.col("stream").isNotNull()
    for stream, upto in version.folded.items():
        later &= (F.col("stream") != stream) | (F.col("batch_id") > upto)
    return _journal(spark, root).where(later).orderBy("seq", "stream", "batch_id").collect()


def _folded_log(spark: SparkSession, pending: Sequence, schema: T.StructType) -> DataFrame:
    with_seq = T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())])
    return fold_log(spark.read.schema(with_seq).parquet(*[batch.path for batch in pending]), SEQ)


def read_snapshot(
    spark: SparkSession, root: str, schema: T.StructType = POST_SCHEMA
) -> DataFrame | None:
    """The published table, without batches that are only in the log."""
    current = current_version(spark, root)
    return None if current is None else _read_days(spark, current.days, schema)


def read_current(
    spark: SparkSession, root: str, since: date | None = None, schema: T.StructType = POST_SCHEMA
) -> DataFrame | None:
    """The published table with all complete later batches folded in; None before the first row.
    With `since`, earlier days are neither listed nor read."""
    current = current_version(spark, root)
    pending = _pending(spark, root, current or NOTHING)
    if current is None and not pending:
        return None
    current = current or NOTHING
    base = _read_days(spark, {d: p for d, p in current.days.items() if not since or d >= str(since)}, schema)
    if not pending:
        return base
    later = _folded_log(spark, pending, schema)
    if since:
        later = _located(later, current).where(F.coalesce(DAY, F.to_date("created_utc")) >= F.lit(since)).drop(DAY)
    return upsert(base, later, unique_updates=True)


def compact(spark: SparkSession, root: str, schema: T.StructType = POST_SCHEMA) -> bool:
    """Fold all complete later batches into the days that hold their keys, new keys into the day of
    their creation, and publish; other days are neither read nor written. False if there was
    nothing to fold. Batches that become complete from here on stay in the log, and so do those
    of a second `compact` that publishes first: whatever a version does not contain is read from the log.
    """
    current = current_version(spark, root) or NOTHING
    pending = _pending(spark, root, current)
    if not pending:
        return False
    # Folded, located and written once; then split into days and merged from there.
    scratch = fresh_dir(spark, "folded")
    located = _located(_folded_log(spark, pending, schema), current)
    located.write.parquet(scratch)
    located = spark.read.schema(located.schema).parquet(scratch)
    day = F.coalesce(DAY, F.to_date("created_utc")).alias(DAY)
    touched = {str(d) for (d,) in located.select(day).distinct().collect()}
    base = _read_days(spark, {d: p for d, p in current.days.items() if d in touched}, schema)
    days = _write_days(upsert(base, located.drop(DAY), unique_updates=True), root)
    fresh, keys, path = located.where(F.col(DAY).isNull()).select(POST_KEY, day), current.keys, f"{root}/keys/{uuid.uuid4().hex}"
    if len(keys) >= MAX_KEY_FOLDERS:
        fresh, keys = fresh.union(_read_keys(spark, keys, POST_KEY).select(POST_KEY, DAY)), ()
    _write_parts(_bucketed(fresh), path, BUCKET)
    last = {batch.stream: batch.batch_id for batch in sorted(pending, key=lambda b: b.batch_id)}
    _publish(spark, root, Version({**current.days, **days}, {**current.folded, **last}, (*keys, path)))
    discard(spark, scratch)
    return True


def transfer(batch: DataFrame, root: str, batch_id: int, stream: str = "transfer") -> None:
    """One staged batch into the published table, all of it or nothing; a repeat changes nothing."""
    write_log_batch(batch, root, batch_id, stream)
    compact(batch.sparkSession, root)
