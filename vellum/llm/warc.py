"""WARC archives: a writer, and a reader that salvages what damage leaves.

Writing: each page is one record, a gzip member of its own. Of records with
equal payloads of MIN_REVISIT bytes or more, the one with the largest page_id
holds the payload and the others are revisit records that name it. Spark's
text sink writes the members as they are: a row is one member, and the
separator between rows is an empty gzip member, so the files are valid
archives on any file system that Spark can write, under its commit protocol.

Reading: files come whole from Spark's binary source (the writer bounds their
size). A record must pass the checks: its member inflates and its checksum
holds, its version line and header are complete, its length is there, and its
block digest is right (SHA-1, SHA-256 and MD5, in base 32 or hex; others are not
checked). Members and plain records may follow one another in one file. After a
failed check the reader searches for the next place, be it a gzip member or a
version line, from which a record passes; the bytes between are logged as one
quarantined gap and what follows is read. Of a member that inflates but whose
checksum is wrong, records with a right block digest are kept, and it is logged.

Cases: a null html is an empty payload; a null url is an empty target; pages
with a null page_id are written and read as such and are never referred to
before others; repeated rows are separate records (of equal ones with the same
largest page_id, all are responses); an empty table gives an empty result;
fields and digests of other makers that are no numbers or cannot be read are
null; a gap in archives that were just written stops the job.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .words import small_batches

MIN_REVISIT = 1000
FILE_RECORDS, FILE_BYTES = 1000, 256 << 20
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_MEMBER = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(block: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(block).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record; with refers_to, a revisit without payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "2020-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Truncated", "length")]
    fields.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(ValueError):
    """A record that fails a check."""


_DIGESTS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}


def digest_bytes(named: str) -> tuple[str, bytes] | None:
    """The algorithm and value of a digest field; None where they cannot be told."""
    kind, colon, value = named.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if not colon or kind not in _DIGESTS:
        return None
    value, size = value.strip(), _DIGESTS[kind]().digest_size
    try:
        found = bytes.fromhex(value) if len(value) == 2 * size else b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return (kind, found) if len(found) == size else None


def parse(data: bytes, at: int = 0, proven: bool = False) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case), block and end of the record at a place in plain bytes.

    With proven, a record must have a block digest that can be checked.
    """
    if not _LINE.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without end")
    fields: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        raise Damaged("no length")
    start, stop = end + 4, end + 4 + int(length)
    if stop + 4 > len(data) or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record cut short")
    block = data[start:stop]
    named = digest_bytes(fields.get("warc-block-digest", ""))
    if named and _DIGESTS[named[0]](block).digest() != named[1]:
        raise Damaged("wrong block digest")
    if proven and not named:
        raise Damaged("nothing proves the block")
    return fields, block, stop + 4


def _body(data: bytes, at: int) -> int:
    """Where the deflated bytes of the member at a place begin."""
    flags, place = data[at + 3] if at + 10 <= len(data) else 0xE0, at + 10
    if flags & 0xE0:
        raise Damaged("no member")
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for flag in (8, 16):  # a name and a comment, each ended by a zero
        if flags & flag:
            place = data.find(b"\0", place) + 1
            if not place:
                raise Damaged("member cut short")
    return place + (2 if flags & 2 else 0)


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, bool]:
    """The member at a place, where it ends, and whether its checksum and length hold."""
    view, place = memoryview(data), _body(data, at)
    unpacker = zlib.decompressobj(-15)
    out: list[bytes] = []
    try:
        while not unpacker.eof and place < len(data):
            out.append(unpacker.decompress(view[place : place + step]))
            place = min(place + step, len(data))
    except zlib.error as e:
        raise Damaged(str(e)) from None
    place -= len(unpacker.unused_data)
    if not unpacker.eof:
        raise Damaged("member cut short")
    found = b"".join(out)
    check = zlib.crc32(found).to_bytes(4, "little") + (len(found) & 0xFFFFFFFF).to_bytes(4, "little")
    if data[place : place + 8] == check:
        return found, place + 8, True
    return found, _next(data, at + 1), False  # nothing tells where it ends


def _inside(found: bytes, proven: bool) -> tuple[list[tuple[dict, bytes]], str]:
    """The good records of an inflated member, and what was wrong with the first bad one."""
    good, at, reason = [], 0, ""
    while at < len(found):
        try:
            fields, block, at = parse(found, at, proven)
            good.append((fields, block))
        except Damaged as e:
            reason = reason or str(e)
            m = _LINE.search(found, at + 1)
            at = m.start() if m else len(found)
    return good, reason


def _next(data: bytes, at: int) -> int:
    """The next place at which a member or a plain record may begin."""
    m = _LINE.search(data, at)
    return min((x for x in (data.find(_MEMBER, at), m.start() if m else -1) if x >= 0), default=len(data))


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", place, fields, block) and ("gap", place, length, reason), in order, of one archive's bytes.

    Places are those of members and of plain records; a member that holds
    damaged records is logged whole, behind its good ones.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            if data.startswith(_MEMBER, at):
                found, end, sound = _inflate(data, at)
                good, wrong = _inside(found, not sound)
                if not good and (wrong or not sound):
                    raise Damaged(wrong or "wrong checksum")
                lost = "" if sound else "wrong checksum"
                lost = lost or (f"inside: {wrong}" if wrong else "")
            else:
                fields, block, end = parse(data, at)
                good, lost = [(fields, block)], ""
        except Damaged as e:
            if bad is None:
                bad, reason = at, str(e)
            at = _next(data, at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at - bad, reason
            bad = None
        for fields, block in good:
            yield "record", at, fields, block
        if lost:
            yield "gap", at, end - at, lost
        at = end
    if bad is not None:
        yield "gap", bad, len(data) - bad, reason


# -- tables -------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in small_batches(batch, "html"):
            payloads = [(x or "").encode() for x in piece["html"].to_pylist()]
            columns = [piece["page_id"].cast(pa.int64()), piece["url"].cast(pa.string()), piece["html"].cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in payloads], pa.int64()), pa.array([hashlib.sha1(x).digest() for x in payloads], pa.binary())], ["page_id", "url", "html", "size", "sha1"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in small_batches(batch, "html"):
            rows = zip(*(piece[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([member(record(p, u, (h or "").encode(), r)) for p, u, h, r in rows], pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, file_records: int = FILE_RECORDS) -> None:
    """Writes pages (page_id, url, html) as gzip archives into a folder.

    A file has at most file_records records, and fewer where so many of the
    longest page could exceed FILE_BYTES before they are packed.

    Only digests and ids are grouped; the join that tells each page its record
    is one that adaptive execution splits, where one payload is very common.
    """
    longest = pages.agg(F.max(F.octet_length("html")).alias("n")).first().n or 1
    file_records = max(1, min(file_records, FILE_BYTES // longest))
    whole = pages.select("page_id", "url", "html").mapInArrow(_digests, "page_id long, url string, html string, size long, sha1 binary")
    small = pages.select("page_id", F.lit("").alias("url"), "html").mapInArrow(_digests, "page_id long, url string, html string, size long, sha1 binary").select("page_id", "size", "sha1")
    equal = small.where(F.col("size") >= min_revisit).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha1", "keeper")
    # payloads too short to be referred to keep clear of each other
    spread = F.when(F.col("size") >= min_revisit, F.col("sha1")).otherwise(F.concat(F.col("sha1"), F.xxhash64("page_id", "url").cast("string").cast("binary")))
    rows = whole.withColumn("sha1", spread).join(equal.hint("shuffle_hash"), "sha1", "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))).select("page_id", "url", "html", "refers_to")
    members = rows.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_records).text(path)


_READ = "file string, place long, length long, kind string, reason string, page_id long, url string, payload binary, payload_digest string, refers_to long"


def _salvaged(keep_payload: bool):
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]

    def number(x: str | None) -> int | None:
        return int(x) if x and re.fullmatch(r"-?[0-9]{1,18}", x) else None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                for found in salvage(data.as_py()):
                    if found[0] == "gap":
                        held.append((path, found[1], found[2], "gap", found[3], None, None, None, None, None))
                        continue
                    _, place, fields, block = found
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = fields.get("warc-type", "")
                    held.append((path, place, len(payload), kind, None, number(fields.get("x-page-id")), fields.get("warc-target-uri"), payload if keep_payload else None, _hex(fields.get("warc-payload-digest"), payload, kind), number(fields.get("x-refers-to-page-id"))))
                    size += len(payload) if keep_payload else 200
                    if size > 8 << 20:
                        yield out(held)
                        held, size = [], 0
        if held:
            yield out(held)

    return rows


def _hex(named: str | None, payload: bytes, kind: str) -> str | None:
    """The payload's SHA-1 in hex: of what was read, or for revisits as the header names it, if it does."""
    if kind != "revisit":
        return hashlib.sha1(payload).hexdigest()
    found = digest_bytes(named or "")
    return found[1].hex() if found and found[0] == "sha1" else None


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """All records and gaps of the archives in a folder; kind is response, revisit, another WARC type, or gap."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_salvaged(keep_payload), _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages into archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = shared.fresh_path(spark, "warc")
    write_archives(pages, path)
    read = shared.written(read_archives(spark, path, keep_payload=False).select("kind", "reason", "page_id", "length", "payload_digest", "refers_to"), "records")
    gaps = read.where("kind = 'gap'").agg(F.count("*").alias("n"), F.first("reason").alias("reason")).first()
    if gaps.n:
        raise RuntimeError(f"{gaps.n} gaps in archives that were just written: {gaps.reason}")
    # a revisit has the length of the payload that it refers to
    sizes = read.where("kind = 'response'").groupBy("payload_digest").agg(F.max("length").alias("full"))
    revisits = read.where("kind = 'revisit'").join(sizes.hint("shuffle_hash"), "payload_digest", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    out = read.where("kind = 'response'").select("page_id", F.col("length").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_to")
    return out.union(revisits.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_to")).select(columns)
