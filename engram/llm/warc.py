"""WARC archives of pages and a reader that salvages damaged ones (op11).

Writing: equal payloads are found by digest; the record of the largest key is a response and the others revisit it without
a payload. Tasks build archives of some megabytes, a gzip member for each record, and Spark's text sink writes each archive
as a file of its own: so writes go to any file system that Spark knows, and are committed or repeated with their task.
The sink ends a row with a separator, so the archive's last byte is left to it (every record ends in a newline, every
member of less than 16 MB in a zero byte; after a longer one stands an empty member).

Reading: Spark reads whole files, a task parses one after another. A record must have a version line, headers, a block
of the stated length, the two line ends after it, and the stated block and payload digests; a member must pass its own
CRC. Where a check fails, the reader searches on for the next member or version line that passes all of them, logs the
bytes between as a gap, and goes on from there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common

GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: A gzip member without content; its last byte, like that of any member of less than 16 MB, is zero.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records as bytes ----------------------------------------------------------------------------------------------


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digest_hex(value: str) -> str | None:
    """Lower-case hex of a labelled SHA-1 in base 32 or hex; None for other algorithms and damaged values."""
    label, _, value = value.partition(":")
    if label.lower() != "sha1":
        return None
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else bytes.fromhex(value).hex()
    except ValueError:
        return "?"


def _header_value(text: str) -> str:
    """Characters that would end or fold a header line, in percent form."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, record_id: str, block: bytes, more: dict[str, str], date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record of WARC 1.1 with the digest of its block."""
    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **more, "WARC-Block-Digest": _sha1(block), "Content-Length": str(len(block))}
    head = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def page_record(page: object, url: str | None, payload: bytes, digest: str, size: int, refers_to: object, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP head only; the head states the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    more = {"WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type": "application/http;msgtype=response"}
    if url is not None:
        more["WARC-Target-URI"] = _header_value(url)
    if revisit:
        more |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{urn(refers_to)}>"}
    return record("revisit" if revisit else "response", urn(page), head if revisit else head + payload, more)


def urn(page: object) -> str:
    return f"urn:page:{'null' if page is None else page}"


def member(data: bytes, level: int = 6) -> bytes:
    """`data` as one gzip member whose last byte is zero, or with an empty member behind it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    packed = packer.compress(data) + packer.flush()
    return packed if packed[-1] == 0 else packed + EMPTY_MEMBER


class Bad(Exception):
    """A check that failed."""


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def http(self) -> tuple[bytes, bytes]:
        """Head and payload of a block that is an HTTP message; else nothing and the block."""
        if self.headers.get("content-type", "").startswith("application/http"):
            head, _, payload = self.block.partition(b"\r\n\r\n")
            return head, payload
        return b"", self.block

    def stated_length(self) -> int | None:
        """Content-Length of the HTTP head."""
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", self.http[0])
        return int(found[1]) if found else None


@dataclass
class Gap:
    """Quarantined bytes [start, end) of an archive, and the first check that failed there."""

    start: int
    end: int
    reason: str


def _plain(data: bytes, at: int) -> Record:
    """The record that begins at a version line."""
    if not (line := VERSION.match(data, at)):
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n", line.end() - 2)
    if stop < 0:
        raise Bad("headers have no end")
    headers: dict[str, str] = {}
    last = ""
    for raw in data[line.end() : stop].split(b"\r\n"):
        text = raw.decode("utf-8", "surrogateescape")
        if text[:1] in (" ", "\t") and last:
            headers[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Bad("a header has no colon")
        last = name.strip().lower()
        headers[last] = value.strip()
    if not headers.get("content-length", "").isdecimal() or len(headers["content-length"]) > 18:
        raise Bad("no length")
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("the block does not end where its length says")
    found = Record(at, end + 4, headers, data[begin:end])
    if (want := _digest_hex(headers.get("warc-block-digest", ""))) and want != hashlib.sha1(found.block).hexdigest():
        raise Bad("block digest")
    if found.kind == "response" and (want := _digest_hex(headers.get("warc-payload-digest", ""))) and want != hashlib.sha1(found.http[1]).hexdigest():
        raise Bad("payload digest")
    return found


def _unpacked(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """Content of the gzip member at `at` and its end; fed in steps, so that what follows it is not copied."""
    reader, parts, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not reader.eof:
            if at >= len(data):
                raise Bad("member is cut off")
            parts.append(reader.decompress(view[at : at + step]))
            at = min(at + step, len(data))
    except zlib.error as e:
        raise Bad("member: " + str(e).rpartition(": ")[2]) from None
    return b"".join(parts), at - len(reader.unused_data)


def _next_start(data: bytes, at: int) -> int:
    found = [x for x in (data.find(GZIP, at), data.find(b"WARC/1.", at)) if x >= 0]
    return min(found, default=len(data))


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of an archive, plain or compressed by record or whole, and the gaps between them.

    Places are of the archive's bytes; records within one member all have the member's. Bytes of a sound member in which
    records are damaged are a gap of the member's place, one for each damaged stretch. An empty member is padding.
    """
    at, gap, reason = 0, -1, ""
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                content, end = _unpacked(data, at)
                inside = list(_plain_all(content))
                if content and not any(isinstance(x, Record) for x in inside):
                    raise Bad(f"member holds no record: {inside[0].reason}")
                found = [Gap(at, end, f"within a member: {x.reason}") if isinstance(x, Gap) else Record(at, end, x.headers, x.block) for x in inside]
            else:
                found = [_plain(data, at)]
                end = found[0].end
        except Bad as e:
            if gap < 0:
                gap, reason = at, str(e)
            at = _next_start(data, at + 1)
            continue
        if gap >= 0:
            yield Gap(gap, at, reason)
            gap = -1
        yield from found
        at = end
    if gap >= 0:
        yield Gap(gap, len(data), reason)


def _plain_all(data: bytes) -> Iterator[Record | Gap]:
    at, gap, reason = 0, -1, ""
    while at < len(data):
        try:
            found = _plain(data, at)
        except Bad as e:
            if gap < 0:
                gap, reason = at, str(e)
            at = data.find(b"WARC/1.", at + 1)
            at = len(data) if at < 0 else at
            continue
        if gap >= 0:
            yield Gap(gap, at, reason)
            gap = -1
        yield found
        at = found.end
    if gap >= 0:
        yield Gap(gap, len(data), reason)


# --- archives as tables --------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest, size, first (the page that holds an equal payload; null below `least_bytes`).

    The payloads' groups are counted by digest and length first. Of groups of over a thousandth of all rows there are fewer
    than a thousand, which are broadcast; rows of other groups of two or more meet their group by a shuffle in which all
    rows without a group, and those of the large ones, are spread evenly.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = common.Scratch(pages.sparkSession, "warc-groups").write(groups, "groups")
    total = rows.count()
    large = F.broadcast(groups.where(F.col("n") * 1000 > total).select("digest", "size", F.col("first").alias("held")))
    rows = rows.join(large, ["digest", "size"], "left")
    alone = F.col("held").isNotNull() | (F.col("size") < least_bytes)
    key = F.when(alone, F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("digest"))
    small = groups.where(F.col("n") * 1000 <= total).select(F.col("digest").alias("key"), F.col("size").alias("of_size"), "first")
    rows = rows.withColumn("key", key)
    joined = rows.join(small, (rows["key"] == small["key"]) & (rows["size"] == small["of_size"]), "left")
    return joined.select("page_id", "url", "html", "digest", rows["size"], F.coalesce("held", "first").alias("first"))


def write_archives(pages: DataFrame, path: str, compressed: bool = True, archive_bytes: int = 16 << 20, least_bytes: int = 1000) -> None:
    """Writes a record for each row of `pages` (page_id, url, html) into archives under `path`, each with a warcinfo first.

    Null and empty html are empty payloads, a null url is left out, control characters of one stand in percent form.
    Payloads of fewer than `least_bytes` are all responses. Of equal larger ones those of the largest page_id are responses
    (several only if rows repeat), the others revisit it; a null page_id revisits any other, and of null ones alone all
    are responses. An archive has `archive_bytes` and its last record, which may be of any length, at most. An empty table
    gives no record.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = member if compressed else bytes
        info = pack(record("warcinfo", "urn:archive", b"software: engram\r\nformat: WARC File Format 1.1\r\n", {"Content-Type": "application/warc-fields"}))
        parts, held = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([info, *parts])[:-1]], type=pa.binary())], names=["archive"])

        for part in common.rows(batches, text="html"):
            for page, url, html, digest, size, first in zip(*part.values(), strict=True):
                revisit = first is not None and page != first
                parts.append(pack(page_record(page, url, common.utf8(html), digest, size, first, revisit)))
                held += len(parts[-1])
                if held >= archive_bytes:
                    yield row()
                    parts, held = [], 0
        if parts:
            yield row()

    archives = with_revisits(pages, least_bytes).mapInArrow(build, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("lineSep", "\0" if compressed else "\n").option("maxRecordsPerFile", 1).text(path)


SCAN = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("gap", pa.string()), ("payload", pa.binary())])
SCAN_DDL = "archive string, start long, end long, type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, gap string, payload binary"


def _row(name: str, x: Record | Gap, payloads: bool) -> dict:
    if isinstance(x, Gap):
        return {"archive": name, "start": x.start, "end": x.end, "gap": x.reason}
    get = x.headers.get
    _, payload = x.http
    if x.kind == "revisit":
        size, digest = x.stated_length(), _digest_hex(get("warc-payload-digest", ""))
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    bare = lambda v: v and v.strip("<>").encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    found = {"archive": name, "start": x.start, "end": x.end, "type": x.kind, "record_id": bare(get("warc-record-id")), "target_uri": bare(get("warc-target-uri")), "refers_to": bare(get("warc-refers-to"))}
    return found | {"payload_bytes": size, "payload_digest": digest, "payload": payload if payloads else None}


def read_archives(spark: SparkSession, path: str, payloads: bool = True, chunk_bytes: int = 1 << 16) -> DataFrame:
    """A row for each valid record of all archives under `path`, and one, with `gap` saying why, for each quarantined stretch.

    archive, start, end (bytes in it), type, record_id, target_uri, refers_to, payload_bytes and payload_digest (of a
    revisit as it states them), gap, payload (null in gaps, revisits' is empty, and all are null without `payloads`). Files
    are handed to Python in chunks, so that a batch of rows stays small; a task holds one archive. Empty files and folders
    give no rows.
    """
    common.small_batches(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    cut = F.expr(f"transform(sequence(0, cast((length - 1) div {chunk_bytes} as int)), i -> substring(content, i * {chunk_bytes} + 1, {chunk_bytes}))")
    chunks = files.select("path", F.posexplode(cut).alias("place", "chunk"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        name, parts = None, []
        for batch in batches:
            for path, place, chunk in zip(*batch.to_pydict().values(), strict=True):
                if place == 0 and parts:
                    yield name, b"".join(parts)
                    parts = []
                name = path
                parts.append(chunk)
        if parts:
            yield name, b"".join(parts)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data in whole(batches):
            held, size = [], 0
            for x in salvage(data):
                held.append(_row(name, x, payloads))
                size += 200 + (len(x.block) if payloads and isinstance(x, Record) else 0)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=SCAN)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=SCAN)

    return chunks.mapInArrow(parse, SCAN_DDL)


def quarantine(scanned: DataFrame) -> DataFrame:
    """The log of gaps: archive, start, end, reason."""
    return scanned.where("gap is not null").select("archive", "start", "end", F.col("gap").alias("reason"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `pages` written to archives and read back: a row for each record. Nulls, ties and repeats as in `write_archives`."""
    path = f"{common.Scratch(spark, 'warc').at}/archives"
    write_archives(common.read(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, payloads=False).where("type in ('response', 'revisit')")
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as long)")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


SQL = """
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN other THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN other THEN first END AS refers_to
FROM (SELECT *, strlen(h) >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS other
  FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""
