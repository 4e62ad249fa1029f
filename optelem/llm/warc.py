"""WARC archives: writing, and a salvage reader.

Records are written through Spark's own writer, so a retried task replaces its file and any file system serves. The
reader takes archives as binary rows and accepts plain records and gzip members. A record counts only if its version
line, header, length, end and digest hold. After a failed check it searches for the next valid gzip member or version
line, goes on from there, and logs the bytes between as a quarantined gap with the reason.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optelem.plans.lookups import settled_lookup

REVISIT_FROM = 1000  # bytes of the payload
MAX_RECORD = 1 << 31
MAX_DUPLICATED = 200_000  # digests with more than one page that are broadcast, 50 bytes each; more of them join by shuffle
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/[01]\.\d+\r?\n")
HEADER_END = re.compile(rb"\r?\n\r?\n")
NEXT_VERSION = re.compile(rb"\nWARC/[01]\.\d+\r?\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.\d+\r?\n")
USUAL_HEADER = BLOCK = 1 << 16
READ_AHEAD = 8  # bytes that inflate may hold


def record_uri(row_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), row_id.cast("string"), F.lit(">"))


def with_roles(pages: DataFrame, row_id: str = "page_id", payload: str = "html") -> DataFrame:
    """`pages` with _payload (binary), _digest and _first: the page that a revisit refers to, else NULL.

    Only digests that occur more than once travel; pages keep their place unless those are too many to broadcast.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    named = pages.select(F.col(row_id).alias("_id"), F.col("url" if "url" in pages.columns else row_id).cast("string").alias("_url"), body.alias("_payload"))
    digested = named.withColumn("_digest", F.sha1("_payload"))
    many = (digested.where(F.octet_length("_payload") >= REVISIT_FROM).groupBy("_digest")
            .agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest", "_last"))
    joined = digested.join(settled_lookup(many, MAX_DUPLICATED), "_digest", "left")
    return joined.withColumn("_first", F.when(~F.col("_id").eqNullSafe(F.col("_last")), F.col("_last"))).drop("_last")


def records(pages: DataFrame, row_id: str = "page_id", payload: str = "html") -> DataFrame:
    """One binary WARC/1.1 record per page, in the column `record`.

    Of pages with equal payloads of at least 1000 bytes that with the largest id is a response and the others revisit
    it; pages that share that id are all responses, and so are shorter ones. A NULL payload is empty, a NULL id gives
    a record without a name, which can revisit but is never referred to.
    """
    rows = with_roles(pages, row_id, payload)
    size = F.octet_length("_payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http.cast("binary"), F.when(F.col("_first").isNull(), F.col("_payload")).otherwise(F.lit(b"")))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    url = F.regexp_replace("_url", r"[\x00-\x20\x7F]+", "%20")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("_first").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", record_uri(F.col("_id"))), line("WARC-Target-URI", url), F.lit("WARC-Date: 2025-01-01T00:00:00Z\r\n"),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("_block"))), line("WARC-Refers-To", record_uri(F.col("_first"))),
        line("WARC-Profile", F.when(F.col("_first").isNotNull(), PROFILE)), line("Content-Length", F.octet_length("_block").cast("string")), F.lit("\r\n"))
    return rows.withColumn("_block", block).select(F.concat(header.cast("binary"), F.col("_block"), F.lit(b"\r\n\r\n")).alias("record"))


def write(pages: DataFrame, folder: str, row_id: str = "page_id", payload: str = "html", records_per_file: int = 2000) -> None:
    """Write an archive file per partition, at most `records_per_file` in each, in place of what `folder` holds.

    The text writer ends each row with a line feed; this is the last byte of the record.
    """
    text = F.substring("record", F.lit(1), F.octet_length("record") - 1).cast("string")
    records(pages, row_id, payload).select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", records_per_file).text(folder)


def _digest_fails(stated: bytes, data: bytes) -> bool:
    kind, _, value = stated.decode("latin-1").strip().partition(":")
    if kind.lower() not in ("sha1", "md5", "sha256"):
        return False
    found = hashlib.new(kind.lower(), data)
    return value.lower() != found.hexdigest() and value.upper().rstrip("=") != b32encode(found.digest()).decode().rstrip("=")


def parse_record(data: bytes, at: int) -> tuple[dict[str, bytes], bytes, int] | str:
    """Header fields, block and end of the record at a position, or the check that failed."""
    version = VERSION.match(data, at)
    if not version:
        return "version"
    end = HEADER_END.search(data, version.end() - 2, version.end() + USUAL_HEADER)
    if not end:  # a longer one ends before the next version line
        following = NEXT_VERSION.search(data, version.end())
        end = HEADER_END.search(data, version.end() - 2, following.start() + 1 if following else len(data))
    if not end:
        return "header"
    fields: dict[str, bytes] = {}
    for line in data[version.end():end.start()].splitlines():
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return "header"
        fields[name.strip().lower().decode("latin-1")] = value.strip()
    length = fields.get("content-length", b"")
    if not length.isdigit() or int(length) > MAX_RECORD:
        return "length"
    stop = end.end() + int(length)
    if stop > len(data):
        return "cut off"
    if data[stop:stop + 4] != b"\r\n\r\n":
        return "end"
    block = data[end.end():stop]
    if "warc-block-digest" in fields and _digest_fails(fields["warc-block-digest"], block):
        return "digest"
    return fields, block, stop + 4


def parse_member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content and end of the gzip member at a position, and the check that failed; the content is then what was unpacked before."""
    unzip, parts, view, step = zlib.decompressobj(31), [], memoryview(data), BLOCK
    while step and at < len(data) and not unzip.eof:
        trial = unzip.copy()
        try:
            parts.append(trial.decompress(view[at:at + step]))
        except zlib.error:
            step //= 2
            continue
        unzip, at = trial, min(len(data), at + step)
    return b"".join(parts), at - len(unzip.unused_data), None if unzip.eof else "cut off" if step else "member"


def _packed_end(data: bytes, at: int, size: int) -> int:
    """Where the first `size` bytes of the content of the member at a position end, or up to READ_AHEAD bytes before."""
    unzip, view, begin, step = zlib.decompressobj(31), memoryview(data), at, BLOCK
    while step and at < len(data):
        trial = unzip.copy()
        try:
            made = len(trial.decompress(view[at:at + step]))
        except zlib.error:
            made = size
        if made < size:
            unzip, size, at = trial, size - made, at + step
        else:
            step //= 2
    return max(begin + 1, at + 1 - READ_AHEAD)


def salvage(data: bytes) -> Iterator[tuple]:
    """('record', first byte, end, None, fields, block) and ('gap', first byte, end, reason, None, None), in file order.

    Records of a gzip member all have the member's bytes. Bytes between them that are no record are a gap with the
    member's bytes too, and with their own first byte and end in the content in place of the fields. Of a member that
    breaks, the records unpacked before count; the gap begins after them.
    """
    at, bad_from, reason = 0, None, None
    while at < len(data):
        found: list[tuple] = []
        broken = None
        if data.startswith(b"\x1f\x8b\x08", at):
            content, stop, broken = parse_member(data, at)
            inner = list(salvage(content)) if not content.startswith(b"\x1f\x8b") else []
            while broken and inner and inner[-1][0] == "gap":
                inner.pop()
            if any(x[0] == "record" for x in inner):
                if broken:
                    stop = _packed_end(data, at, inner[-1][2])
                found = [(x[0], at, stop, x[3], x[4] if x[0] == "record" else x[1:3], x[5]) for x in inner]
            why = broken or "content"
        else:
            one = parse_record(data, at)
            if not isinstance(one, str):
                found, stop = [("record", at, one[2], None, one[0], one[1])], one[2]
            why = one if isinstance(one, str) else ""
        if found:
            if bad_from is not None:
                yield "gap", bad_from, at, reason, None, None
                bad_from = None
            yield from found
            at = stop
            if not broken:
                continue
        if bad_from is None:
            bad_from, reason = at, why
        following = START.search(data, at if found else at + 1)
        at = following.start() if following else len(data)
    if bad_from is not None:
        yield "gap", bad_from, len(data), reason, None, None


_FOUND = ("file string, first_byte long, end_byte long, gap_reason string, content_first long, content_end long, record_type string, record_id string, target_uri string, "
          "refers_to string, payload_digest string, payload_bytes long, payload binary")
_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in _FOUND.split(", "))])
HTTP_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def _row(file: str, found: tuple, payloads: bool) -> tuple:
    kind, first, end, reason, fields, block = found
    if kind == "gap":
        return file, first, end, reason, *(fields or (None, None)), None, None, None, None, None, None, None

    def text(name: str) -> str | None:
        return fields[name].decode("utf-8", "replace") if name in fields else None

    payload = block
    http = block.startswith(b"HTTP/") and HEADER_END.search(block)
    if http:
        payload = block[http.end():]
    revisit = fields.get("warc-type") == b"revisit"
    stated = HTTP_LENGTH.search(block[:http.end()]) if http and revisit else None
    size = int(stated[1]) if stated else None if revisit else len(payload)
    digest = text("warc-payload-digest") if revisit else "sha1:" + hashlib.sha1(payload).hexdigest()
    return file, first, end, None, None, None, text("warc-type"), text("warc-record-id"), text("warc-target-uri"), text("warc-refers-to"), digest, size, payload if payloads else None


def _salvaged(payloads: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("path", "content"))):
            held, size = [], 0
            for found in salvage(content.as_py() or b""):
                held.append(_row(path.as_py(), found, payloads))
                size += len(held[-1][-1] or b"")
                if size > 1 << 23 or len(held) >= 5000:
                    yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in held], schema=_SCHEMA)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in held], schema=_SCHEMA)


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of archives given as `path` and `content`, as the binaryFile source reads them.

    Gaps have a `gap_reason` (version, header, length, cut off, end, digest, member, content) and no record; an empty
    or NULL file has neither. A gap within a gzip member that holds records besides has the member's bytes, and its
    own place in the content as `content_first` and `content_end`. The payload of an HTTP response is its body, its digest is computed from it; a revisit
    has an empty payload, and its digest and size are those that it states for the page it refers to. Without
    `payloads` the column `payload` is NULL.
    """
    return files.select("path", "content").mapInArrow(partial(_salvaged, payloads), _FOUND)
