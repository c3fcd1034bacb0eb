"""WARC records in ZIP packages, read by range without extraction.

A package is a ZIP archive of stored members: `archive/data.warc.gz`, one gzip member per record,
and `indexes/index.cdxj`, one line per record with its offset and length in the WARC member. The
reader parses the end record, the ZIP64 records and the central directory, locates the members,
reads the index and then fetches records one range at a time.

Packages are written by tasks to the shared folder under names of their own attempt; a package
counts only if it is in the manifest, which Spark commits with the task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.common import PART_BYTES, parts, shuffle_partitions, stored
from tallyvox.session import fresh_dir

PACKAGE_BYTES = 64 << 20
WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
RECORD_URN = "urn:page:"
DATE = "2024-01-01T00:00:00Z"  # the tables give no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Signatures and special numbers of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
FULL32, FULL16, STORED, EXTRA64 = 0xFFFFFFFF, 0xFFFF, 0, 1
MAX_COMMENT = 0xFFFF


# --- files in the shared folder --------------------------------------------------------------


def open_input(uri: str):
    """A file of any store that Arrow reads (file, hdfs, s3, gs), to be read by range."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def open_output(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def file_uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


# --- records ---------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Record(NamedTuple):
    kind: str
    record_id: int | None
    payload_bytes: int
    digest: str
    refers_to: int | None
    url: str | None
    payload: bytes | None  # of a revisit: None


def _urn(number: int | None) -> str:
    return f"<{RECORD_URN}{'' if number is None else number}>"


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(RECORD_URN)
    return int(digits) if digits else None


def warc_record(number: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit has the HTTP header of the full payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(number)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", target)] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        *([("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode("utf-8") + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs if name}


def parse_record(data: bytes) -> Record:
    """Raises ValueError if a response's payload does not have its length or digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return Record(
        kind,
        _number(fields["warc-record-id"]),
        size,
        digest,
        _number(fields.get("warc-refers-to")),
        fields.get("warc-target-uri"),
        payload if kind == "response" else None,
    )


# --- packages --------------------------------------------------------------------------------


class PackageWriter:
    """One package. Records go straight into the stored WARC member; the index follows it."""

    def __init__(self, uri: str):
        self.uri, self.index, self.size = uri, [], 0
        self.sink = open_output(uri)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(WARC_MEMBER, "w", force_zip64=True)

    def add(self, record: bytes, number: int | None, url: str | None) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        entry = {"url": url, "id": number, "offset": self.size, "length": len(packed)}
        self.index.append(json.dumps(entry))
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(INDEX_MEMBER, "w", force_zip64=True) as member:
            for line in self.index:
                member.write(f"{line}\n".encode())
        self.zip.close()
        self.sink.close()
        return self.uri, len(self.index)


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored_size: int
    header: int  # where its local header begins


def _at(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) != size:
        raise ValueError("the archive ends too early")
    return data


def _end_record(file) -> tuple[int, int, int]:
    """(entries, size, offset) of the central directory, from the ZIP64 record where there is one."""
    length = file.size()
    tail_at = max(0, length - 22 - MAX_COMMENT)
    tail = _at(file, tail_at, length - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0:  # a comment may hold the signature: its own length must fit
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("not a ZIP archive")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    locator_at = tail_at + at - 20
    if locator_at >= 0:
        signature, _, end64, _ = struct.unpack("<IIQI", _at(file, locator_at, 20))
        if signature == LOCATOR64:
            fixed = _at(file, end64, 56)
            if struct.unpack_from("<I", fixed)[0] != END64:
                raise ValueError("damaged ZIP64 end record")
            entries, size, offset = struct.unpack_from("<QQQ", fixed, 32)
    return entries, size, offset


def _extra64(extra: bytes, wanted: list[int]) -> list[int]:
    """Sizes and offset, with those that did not fit taken from the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(values) if value == FULL32 else value for value in wanted]
        at += 4 + size
    return wanted


def directory(file) -> list[Member]:
    """The members by the central directory."""
    entries, size, offset = _end_record(file)
    data, at, found = _at(file, offset, size), 0, []
    for _ in range(entries):
        fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
        if fields[0] != ENTRY:
            raise ValueError("damaged central directory")
        flags, method, packed, plain = fields[3], fields[4], fields[8], fields[9]
        name_size, extra_size, comment_size, header = fields[10], fields[11], fields[12], fields[16]
        name = data[at + 46 : at + 46 + name_size]
        extra = data[at + 46 + name_size : at + 46 + name_size + extra_size]
        plain, packed, header = _extra64(extra, [plain, packed, header])
        found.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, plain, packed, header))
        at += 46 + name_size + extra_size + comment_size
    return found


def data_offset(file, member: Member) -> int:
    """Where the bytes of a stored member begin: after its local header."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed; only stored members are read by range")
    head = _at(file, member.header, 30)
    if struct.unpack_from("<I", head)[0] != LOCAL:
        raise ValueError("damaged local header")
    name_size, extra_size = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name_size + extra_size


def locate(uri: str) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of every record, by the index; lines are read in blocks."""
    with open_input(uri) as file:
        members = {m.name: m for m in directory(file)}
        base, index = data_offset(file, members[WARC_MEMBER]), members[INDEX_MEMBER]
        at, rest = data_offset(file, index), b""
        end = at + index.stored_size
        while at < end:
            size = min(1 << 20, end - at)
            *lines, rest = (rest + _at(file, at, size)).split(b"\n")
            at += size
            for line in lines:
                entry = json.loads(line)
                yield base + entry["offset"], entry["length"]


def read_range(file, offset: int, length: int) -> Record:
    return parse_record(gzip.GzipFile(fileobj=io.BytesIO(_at(file, offset, length))).read())


# --- tables ----------------------------------------------------------------------------------


def with_originals(pages: DataFrame, key: str, payload: Column, least_bytes: int) -> DataFrame:
    """key, url, payload (binary), original: of equal payloads of at least `least_bytes`, the
    smallest key; null where a payload occurs once, or is smaller. Payloads are told apart by
    SHA-256 and length; only those that occur more than once are joined."""
    same = F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload"))
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col("url"), payload.alias("payload")).withColumn(
        "same", same
    )
    repeated = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("same")
        .agg(F.min("id").alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .select("same", "original")
    )
    return rows.join(repeated, "same", "left").drop("same")


def write_packages(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    html: str = "html",
    least_revisit_bytes: int = 0,
    package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write a record per row into packages below `folder` and return the manifest (uri, records).

    The payload is the text in UTF-8 (null: empty). Of records with equal payloads of at least
    `least_revisit_bytes`, those with the smallest key are responses, the others revisit it; a
    repeated row with that same key is a response as well. Null keys never come before others. An
    empty table writes no package.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = with_originals(pages, key, payload, least_revisit_bytes).select("id", "url", "payload", "original")
    base = file_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, done, writer = uuid.uuid4().hex, [], None
        for batch in parts(batches, text=2):
            for number, url, body, original in zip(*(column.to_pylist() for column in batch.columns)):
                if writer is None:
                    writer = PackageWriter(f"{base}/{attempt}-{len(done):05d}.wacz")
                revisit = original is not None and original != number
                writer.add(warc_record(number, url, body, original, revisit), number, url)
                if writer.size >= package_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
            names=["uri", "records"],
        )

    return stored(rows.mapInArrow(run, "uri string, records long"), "warc-manifest")


READ_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, payload binary"
)


def read_packages(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the packages in `manifest` (uri): page_id, payload_bytes, payload_digest,
    record_type, refers_to, url and payload (null for revisits, or unless wanted). A response
    whose payload does not match its digest raises an error."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                found = list(locate(uri))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uri] * len(found)),
                        pa.array([o for o, _ in found], pa.int64()),
                        pa.array([n for _, n in found], pa.int64()),
                    ],
                    names=["uri", "at", "length"],
                )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None

        def table(records: list[Record]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
            rows = [(r.record_id, r.payload_bytes, r.digest, r.kind, *r[4:]) for r in records]
            columns = zip(*rows) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            records, size = [], 0
            for uri, at, length in zip(*(column.to_pylist() for column in batch.columns)):
                if uri != name:
                    if file is not None:
                        file.close()
                    name, file = uri, open_input(uri)
                record = read_range(file, at, length)
                size += len(record.payload or b"") if with_payload else 0
                records.append(record if with_payload else record._replace(payload=None))
                if size > PART_BYTES:
                    yield table(records)
                    records, size = [], 0
            yield table(records)
        if file is not None:
            file.close()

    located = manifest.select("uri").repartition("uri").mapInArrow(places, "uri string, at long, length long")
    # Neighbouring records of a package stay together, whatever the size of a package. A given
    # number of tasks: by the few bytes of the ranges, all of them would be coalesced into one.
    spread = located.withColumn("block", F.floor(F.col("at") / (4 << 20)))
    tasks = shuffle_partitions(manifest.sparkSession)
    spread = spread.repartition(tasks, "uri", "block").sortWithinPartitions("uri", "at")
    return spread.select("uri", "at", "length").mapInArrow(fetch, READ_SCHEMA)


def round_trip(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Write the pages into packages in a new folder and read them back."""
    return read_packages(write_packages(pages, fresh_dir(pages.sparkSession, name)), with_payload=False)
