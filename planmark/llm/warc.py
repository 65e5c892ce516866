"""WARC archives: a writer on Spark's own text files and a salvage reader.

Writing. Payloads with equal bytes share one digest; of those of at least ``least`` bytes the record
with the smallest id is the response and the others are revisits that name it and carry no payload.
A record is one element of a text file whose element separator is a line end, so archives go to any
file system that Spark can write, and end in size where ``records_per_file`` ends.

Reading. The reader walks the bytes of an archive. A record must begin with a version line, have
well-formed headers with a Content-Length that stays inside the archive, end in two line ends, and
match its block and payload digests. Where a check fails, the reader searches for the next offset at
which a whole valid record starts - the next version line, or the next gzip member that opens and
holds nothing but records, whichever comes first - and logs the bytes between as a quarantined gap. So
plain and compressed records may stand in one archive, and a damaged member costs that member alone. An
archive is one row of Spark's binary source, so a single file must fit into a task; very long payloads
are records like others.

Behaviour at the edges: a null payload is an empty one; null ids are written without an id and sort
last among equal payloads; equal ids with equal payloads all carry the same reference; an empty table
writes no record and reads back as no row; columns other than id, url and payload are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planmark.session import cut_lineage

VERSION = b"WARC/1.0\r\n"
DATE = "2020-01-01T00:00:00Z"
ID_PREFIX = "urn:page:"
RECORDS_PER_FILE = 2_000
_STEP = 1 << 16
_MEMBER = b"\x1f\x8b\x08"
_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_LENGTH = re.compile(r"\d{1,18}\Z")


# writing


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of ``payload``: four times 40 bits make eight digits each."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def assign_types(df: DataFrame, record_id: str, payload: str, least: int = 0) -> DataFrame:
    """(r_id, r_payload, r_digest, r_bytes, r_first): r_first is the id of the response that a row
    revisits, null for responses. Equal payloads are told by SHA-256."""
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = df.select(
        F.col(f"`{record_id}`").alias("r_id"), *([F.col("`url`").alias("r_url")] if "url" in df.columns else []),
        body.alias("r_payload"), F.octet_length(body).cast("long").alias("r_bytes"), F.sha2(body, 256).alias("r_same"),
    )
    # only payloads that occur again: the fewer, the less there is to join the texts with
    firsts = rows.filter(F.col("r_bytes") >= least).groupBy("r_same").agg(
        F.min("r_id").alias("f_id"), F.count("*").alias("f_n")
    ).filter("f_n > 1").select(F.col("r_same").alias("f_same"), "f_id")
    firsts = cut_lineage(firsts)  # so that the planner knows how few they are before it moves the texts
    joined = rows.join(firsts, F.col("r_same") == F.col("f_same"), "left")
    revisits = F.col("f_id").isNotNull() & ~F.col("f_id").eqNullSafe(F.col("r_id"))
    return joined.withColumn("r_first", F.when(revisits, F.col("f_id"))).withColumn(
        "r_digest", base32_sha1(F.col("r_payload"))
    ).drop("f_same", "f_id", "r_same")


def record_text(rows: DataFrame) -> Column:
    """One record without its last line end, which the file writer adds."""
    end = F.lit("\r\n")
    revisit = F.col("r_first").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("r_payload"))
    named = F.when(
        F.col("r_id").isNotNull(),
        F.concat(F.lit(f"WARC-Record-ID: <{ID_PREFIX}"), F.col("r_id").cast("string"), F.lit(">\r\n")),
    ).otherwise(F.lit(""))
    refers = F.when(
        revisit,
        F.concat(
            F.lit(f"WARC-Refers-To: <{ID_PREFIX}"), F.col("r_first").cast("string"),
            F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"),
        ),
    ).otherwise(F.lit(""))
    target = (
        F.when(
            F.col("r_url").isNotNull(),
            F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("r_url", "[\\x00-\\x20\\x7F]", ""), end),
        ).otherwise(F.lit(""))
        if "r_url" in rows.columns else F.lit("")
    )
    return F.concat(
        F.lit("WARC/1.0\r\n"), F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), end,
        named, target, F.lit(f"WARC-Date: {DATE}\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("r_digest"), end, refers,
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), end, end, block, end,
    )


def write_archives(
    df: DataFrame, path: str, record_id: str = "page_id", payload: str = "html", least: int = 0,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write a record per row into archives in the folder ``path``."""
    rows = assign_types(df, record_id, payload, least)
    rows.select(record_text(rows).alias("value")).write.option("lineSep", "\r\n").option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def gzip_record(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


# reading


def _parse(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record at ``at`` and the offset after it, or None if a check fails."""
    if not data.startswith(VERSION, at):
        return None
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return None
    headers: dict[str, str] = {}
    for line in data[at + len(VERSION) : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not _NAME.fullmatch(name):
            return None
        headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not _LENGTH.match(length) or "warc-type" not in headers:
        return None
    start = head_end + 4
    end = start + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[start:end]
    for name in ("warc-block-digest", "warc-payload-digest"):
        kind, _, wanted = headers.get(name, "").partition(":")
        if kind.lower() == "sha1" and not (name == "warc-payload-digest" and headers["warc-type"] == "revisit"):
            if base64.b32encode(hashlib.sha1(block).digest()).decode() != wanted.upper():
                return None
    return {"headers": headers, "payload": block}, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and the offset after it, or None if it is damaged."""
    opener, parts, place = zlib.decompressobj(31), [], at
    try:
        while not opener.eof and place < len(data):
            parts.append(opener.decompress(data[place : place + _STEP]))
            place += _STEP
    except zlib.error:
        return None
    if not opener.eof:
        return None
    return b"".join(parts), min(place, len(data)) - len(opener.unused_data)


def _starts(data: bytes) -> Iterator[int]:
    """The offsets, in order, at which a record may start: version lines and gzip members alike."""
    following = {mark: data.find(mark) for mark in (VERSION, _MEMBER)}
    while True:
        left = [place for place in following.values() if place >= 0]
        if not left:
            return
        at = min(left)
        yield at
        following = {m: data.find(m, p + 1) if p == at else p for m, p in following.items()}


def _found(data: bytes, at: int) -> tuple[list[dict], int] | None:
    """The record at ``at``, or all records of the gzip member there, and the offset after them."""
    if not data.startswith(_MEMBER, at):
        parsed = _parse(data, at)
        return None if parsed is None else ([parsed[0]], parsed[1])
    opened = _member(data, at)
    if opened is None:
        return None
    records, place = [], 0
    while place < len(opened[0]):
        parsed = _parse(opened[0], place)
        if parsed is None:
            return None
        records.append(parsed[0])
        place = parsed[1]
    return (records, opened[1]) if records else None


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive in order; every byte belongs to one of them, but that the records
    of one gzip member share its bytes."""
    at = 0
    for start in _starts(data):
        found = _found(data, start) if start >= at else None
        if found is None:
            continue
        if start > at:
            yield {"kind": "gap", "at": at, "after": start}
        for record in found[0]:
            yield {"kind": "record", "at": start, "after": found[1], **record}
        at = found[1]
    if at < len(data):
        yield {"kind": "gap", "at": at, "after": len(data)}


_FIELDS = (
    "kind string, begins long, ends long, record_type string, record_id string, target_uri string, "
    "payload_digest string, refers_to string, payload binary"
)


def read_archives(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, kind, begins, ends, record_type, record_id, target_uri, payload_digest, refers_to, payload)
    of every record (kind ``record``) and every quarantined stretch of bytes (kind ``gap``)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, data in zip(batch["path"], batch["content"]):
                rows = []
                for found in salvage(data.as_py()):
                    headers = found.get("headers", {})
                    rows.append({
                        "path": place.as_py(), "kind": found["kind"], "begins": found["at"], "ends": found["after"],
                        "record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"),
                        "target_uri": headers.get("warc-target-uri"),
                        "payload_digest": headers.get("warc-payload-digest"), "refers_to": headers.get("warc-refers-to"),
                        "payload": found.get("payload"),
                    })
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(walk, "path string, " + _FIELDS)


_SCHEMA = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("begins", pa.int64()), ("ends", pa.int64()),
    ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()),
])


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take the length of
    the payload from the response that they refer to, null if that one was not recovered."""
    number = lambda c: F.regexp_extract(c, f"<{ID_PREFIX}(-?\\d+)>", 1)
    id_of = lambda c: F.when(number(c) != "", number(c).cast("long"))
    rows = records.filter("kind = 'record'").select(
        id_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("own_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        id_of("refers_to").alias("refers_to"),
    )
    rows = cut_lineage(rows)  # archives are read once
    lengths = rows.filter("record_type = 'response' and page_id is not null").groupBy(
        F.col("page_id").alias("l_id"), F.col("payload_digest").alias("l_digest")
    ).agg(F.max("own_bytes").alias("l_bytes"))
    same = (F.col("refers_to") == F.col("l_id")) & (F.col("payload_digest") == F.col("l_digest"))
    joined = rows.join(lengths, same, "left")
    size = F.when(F.col("record_type") == "revisit", F.col("l_bytes")).otherwise(F.col("own_bytes"))
    return joined.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
