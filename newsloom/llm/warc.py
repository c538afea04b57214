"""WARC archives: a deduplicating writer and a salvage reader.

Writer: each record is one gzip member, so that a damaged one costs no other.
Payloads that repeat (by SHA-256, from ``least_revisit`` bytes on) are kept once;
the others become revisit records that name the kept one.  Files are written by
Spark's own committed text writer, so task retries leave no halves: it puts one
byte after each value, and a gzip member ends in a zero byte (the high byte of
a size below 16 MB), so a member without its last byte and a zero byte as
separator give the exact archive bytes.  A file holds at most ``FILE_BYTES`` of
payload, a single larger one aside: the longest payload up to ``LONG`` bounds
the records of a file, and longer ones go to files of their own bound.  Only
digests are joined, so payloads are not shuffled while the repeated digests fit
a broadcast (``BROADCAST_DIGESTS``); beyond it adaptive execution splits hot
ones.

Reader: members and bare records are checked (gzip sums, version line, content
length, payload digest).  After a failed check it searches for the next member
or version line that passes them all, goes on there, and logs the skipped bytes
as a quarantined gap.  A member that is damaged or cut short is read as far as it
inflates, and version lines are searched for in what it gives: records there
whose payload digest holds are recovered, the others are gaps.  Each member is
inflated once, in pieces.

Positions and lengths count archive bytes.  A member's first record or gap has
the member's length, what follows in the same member length 0.

Defined results: null html is an empty payload; rows whose id equals the
group's smallest are responses, also when repeated; in a group without any id
all are responses; a null url is left out of the record; an empty table gives
an archive without records; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, staged, staged_path, unstage

FILE_BYTES, LONG = 1 << 30, 8 << 20
BROADCAST_DIGESTS = 1 << 18
PIECE = 1 << 16
GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_URN = "urn:page:"


def _member(record: bytes) -> bytes:
    c = zlib.compressobj(5, zlib.DEFLATED, 31)
    out = c.compress(record) + c.flush()
    if out[-1]:  # 16 MB or more: end with an empty member, whose last byte is zero
        c = zlib.compressobj(5, zlib.DEFLATED, 31)
        out += c.compress(b"") + c.flush()
    return out


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; ``refers_to`` makes it a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("ascii", "replace") + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 100,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Archive files under ``path``."""
    small_batches(pages.sparkSession, 500)
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    digests = rows.select("page_id", "digest", F.octet_length("payload").alias("n_bytes"))
    kept = staged(
        digests.where(F.col("n_bytes") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null").select("digest", "first_id"),
        "digests",
    )
    few = kept.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    longest, long_rows, usual = digests.agg(F.max("n_bytes"), F.count(F.when(F.col("n_bytes") > LONG, 1)), F.max(F.when(F.col("n_bytes") <= LONG, F.col("n_bytes")))).first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                again = r["first_id"] if r["first_id"] != r["page_id"] else None
                made.append(_member(record(r["page_id"], r["url"], r["payload"], r["digest"], again, date))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    def write(part: DataFrame, most: int) -> None:
        joined = part.join(F.broadcast(kept) if few else kept, "digest", "left").select("page_id", "url", "payload", "digest", "first_id")
        values = joined.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
        values.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", max(1, FILE_BYTES // max(most, 4096))).text(path)

    write(rows.where(F.octet_length("payload") <= LONG) if long_rows else rows, usual or 0)
    if long_rows:
        write(rows.where(F.octet_length("payload") > LONG), longest)
    unstage(kept)


def _parsed(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record that starts at ``at``, where it ends, and why it failed if it is None."""
    if not _VERSION.match(data, at):
        return None, at, "version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None, at, "header end"
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    if not fields.get("content-length", "").isdigit():
        return None, at, "content length"
    begin, size = stop + 4, int(fields["content-length"])
    end = begin + size + 4
    if data[begin + size : end] != b"\r\n\r\n":
        return None, at, "record end"
    block = data[begin : begin + size]
    head = block.find(b"\r\n\r\n")
    body = block[head + 4 :] if block.startswith(b"HTTP/") and head >= 0 else block
    want, kind = fields.get("warc-payload-digest", ""), fields.get("warc-type", "")
    digest = hashlib.sha256(body).hexdigest()
    if kind != "revisit" and want.startswith("sha256:") and want[7:] != digest:
        return None, at, "payload digest"
    return {"fields": fields, "type": kind, "body": body, "digest": want.removeprefix("sha256:") if kind == "revisit" else digest}, end, ""


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at ``at`` gives, where it ends, and why it failed; of a damaged one, what comes before the damage."""
    inflate, view, out, pos = zlib.decompressobj(31), memoryview(data), [], at
    while not inflate.eof:
        if pos >= len(data):
            return b"".join(out), pos, "gzip end"
        piece = view[pos : pos + PIECE]
        try:
            out.append(inflate.decompress(piece))
        except zlib.error:
            # Byte by byte: what the piece gives before the damage counts too.
            again = zlib.decompressobj(31)
            size = sum(map(len, out))
            kept = [again.decompress(view[at:pos])] if pos > at else []
            try:
                for i in range(len(piece)):
                    kept.append(again.decompress(piece[i : i + 1]))
            except zlib.error:
                pass
            found = b"".join(kept)
            return found if len(found) >= size else b"".join(out), at, "gzip data"
        pos += len(piece)
    return b"".join(out), pos - len(inflate.unused_data), ""


def _inside(inner: bytes, trusted: bool) -> Iterator[tuple[dict | None, str]]:
    """Records and gaps of a member's content; in an untrusted one only records with a payload digest count."""
    pos, failed = 0, ""
    while pos < len(inner):
        found, end, why = _parsed(inner, pos)
        if found is not None and (trusted or found["fields"].get("warc-payload-digest", "").startswith("sha256:")):
            if failed:
                yield None, failed
            yield found, ""
            pos, failed = end, ""
            continue
        failed = failed or why or "no payload digest"
        following = _VERSION.search(inner, pos + 1)
        pos = following.start() if following else len(inner)
    if failed:
        yield None, failed


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(offset, length, record or None for a gap, reason of a gap), in order, over all bytes."""
    pos, gap, reason = 0, 0, ""
    while pos < len(data):
        found, end, why = [], pos, "no record start"
        if data[pos : pos + 3] == GZIP:
            inner, end, why = _inflated(data, pos)
            found = list(_inside(inner, not why)) if inner else []
            if why and not any(x for x, _ in found):
                found = []
        elif _VERSION.match(data, pos):
            record, end, why = _parsed(data, pos)
            found = [(record, "")] if record else []
        if found and gap < pos:
            yield gap, pos - gap, None, reason or "no record start"
        if why:
            following = _START.search(data, pos + 1)
            end = following.start() if following else len(data)
            if found:  # a damaged member with records: its bytes up to the next start are the gap
                yield pos, end - pos, None, why
                yield from ((pos, 0, x, "") for x, _ in found if x)
                gap, reason = end, ""
            elif gap == pos or not reason:
                reason = why
        elif found:
            for i, (x, inner_why) in enumerate(found):
                yield pos, 0 if i else end - pos, x, inner_why
            gap, reason = end, ""
        else:  # an empty member
            if gap < pos:
                yield gap, pos - gap, None, reason or "no record start"
            gap, reason = end, ""
        pos = end
    if gap < len(data) and gap < pos:
        yield gap, len(data) - gap, None, reason or "no record start"


READ_SCHEMA = (
    "path string, position long, n_bytes long, gap_reason string, record_type string, page_id long, url string, payload binary, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record, and one for each quarantined gap (``gap_reason`` is not null)."""
    from urllib.parse import unquote

    small_batches(spark, 500)

    def number(x: str | None) -> int | None:
        x = (x or "").strip("<>").removeprefix(_URN)
        return int(x) if x.lstrip("-").isdigit() else None

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, n, r, why in salvage(content.as_py()):
                    if r is None:
                        rows.append((source, at, n, why, *[None] * 7))
                        continue
                    f = r["fields"]
                    length = int(f["x-payload-length"]) if r["type"] == "revisit" and f.get("x-payload-length", "").isdigit() else len(r["body"])
                    uri = f.get("warc-target-uri")
                    rows.append((
                        source, at, n, None, r["type"], number(f.get("warc-record-id")), None if uri is None else unquote(uri),
                        r["body"] if payloads and r["type"] != "revisit" else None, length, r["digest"], number(f.get("warc-refers-to")),
                    ))
                    size += len(r["body"]) if payloads else 0
                    if len(rows) >= 2000 or size > 1 << 24:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """``pages`` written under ``path`` (a new shared folder by default) and what is read back from there."""
    path = path or staged_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path, payloads=False)
