"""WARC: writing, reading back, and salvage of damaged archives."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from optelem.llm import warc


def record(payload: bytes, kind: str = "response", name: str = "a", digest: bool = True) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>"]
    lines += [f"WARC-Block-Digest: sha1:{hashlib.sha1(payload).hexdigest()}"] * digest
    return ("\r\n".join([*lines, f"Content-Length: {len(payload)}"]) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parts(data):
    return [(k, data[a:b], why, block) for k, a, b, why, _, block in warc.salvage(data)]


def test_sound_archives_of_both_kinds():
    plain = [record(b"one"), record(b""), record(b"WARC/1.1\r\n inside a block")]
    assert parts(b"".join(plain)) == [("record", r, None, b) for r, b in zip(plain, (b"one", b"", b"WARC/1.1\r\n inside a block"))]
    members = [gzip.compress(r) for r in plain]
    assert parts(b"".join(members)) == [("record", m, None, b) for m, b in zip(members, (b"one", b"", b"WARC/1.1\r\n inside a block"))]
    assert parts(b"") == []


@pytest.mark.parametrize(("bad", "why"), [
    (b"garbage", "version"), (record(b"abc")[:-6], "end"), (record(b"abc").replace(b"abc\r", b"abd\r"), "digest"), (record(b"abc").replace(b"h: 3", b"h: x"), "length"),
    (record(b"abc").replace(b"h: 3", b"h: 999999"), "cut off"), (b"WARC/1.1\r\nno colon\r\n\r\n", "header"), (gzip.compress(record(b"abc" * 99))[:40], "member"),
    (gzip.compress(b"no record"), "content")])
def test_salvage_goes_on_after_damage(bad, why):
    first, last = record(b"first"), record(b"last", name="z")
    found = parts(first + bad + last)
    assert found[0] == ("record", first, None, b"first") and found[-1] == ("record", last, None, b"last")
    gaps = [f for f in found if f[0] == "gap"]
    assert b"".join(g[1] for g in gaps) == bad and gaps[0][2] in (why, "member", "cut off")
    zipped = parts(gzip.compress(first) + bad + gzip.compress(last))
    assert [f[3] for f in zipped if f[0] == "record"] == [b"first", b"last"]


def test_every_byte_is_a_record_or_a_gap():
    chance = random.Random(6)
    for _ in range(150):
        pieces = [record(bytes(chance.choices(b"ab\r\nWARC/1. ", k=chance.randint(0, 60))), name=str(i)) for i in range(5)]
        data = bytearray(b"".join(gzip.compress(p) if chance.random() < 0.5 else p for p in pieces))
        for _ in range(chance.randint(0, 3)):
            at = chance.randrange(len(data))
            data[at:at + chance.randint(0, 20)] = bytes(chance.choices(range(256), k=chance.randint(0, 20)))
        spans = [(a, b) for _, a, b, *_ in warc.salvage(bytes(data))]
        assert spans[0][0] == 0 and spans[-1][1] == len(data)
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_pages_written_and_read_back(spark, tmp_path):
    long, other = "<p>é same\r\n\r\nWARC/1.1\r\n</p>" * 60, "\n" * 1000
    data = [(1, "http://a/ b", long), (2, "u\r\nEvil: 1", long), (9, None, long), (9, "u", long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", other), (None, "u", other), (None, "u", "x"), (7, "u", "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    warc.write(pages, str(tmp_path / "w"), records_per_file=3)
    found = warc.read(spark.read.format("binaryFile").load(str(tmp_path / "w")))
    assert found.where("gap_reason IS NOT NULL").count() == 0
    got = [(r["record_id"] or "", r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"][5:]) for r in found.collect()]
    want = []
    for page, _, html in data:
        body = (html or "").encode()
        same = [p for p, _, h in data if (h or "").encode() == body and p is not None]
        target = max(same, default=None) if len(body) >= 1000 else None
        revisit = target is not None and page != target
        want.append((f"<urn:page:{page}>" if page is not None else "", "revisit" if revisit else "response", f"<urn:page:{target}>" if revisit else None, len(body), hashlib.sha1(body).hexdigest()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {bytes(r["payload"]) for r in found.where("record_type = 'response'").collect()} == {(h or "").encode() for *_, h in data}
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark.read.format("binaryFile").load(str(tmp_path / "none"))).count() == 0


def test_long_headers_are_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "data:," + "x" * 100_000, "<p>one</p>"), (2, "u", "two")], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), str(tmp_path / "w"))
    found = warc.read(spark.read.format("binaryFile").load(str(tmp_path / "w"))).collect()
    assert sorted((r["gap_reason"], r["record_id"], bytes(r["payload"])) for r in found) == [(None, "<urn:page:1>", b"<p>one</p>"), (None, "<urn:page:2>", b"two")]
    unended = b"WARC/1.1\r\na: " + b"x" * 100_000
    assert [(k, why) for k, _, why, _ in parts(unended + b"\r\n" + record(b"one"))] == [("gap", "header"), ("record", None)]


def test_records_of_damaged_members_count(spark, tmp_path):
    records = [record(bytes(random.Random(i).choices(range(256), k=3000)), name=str(i)) for i in range(30)]
    blocks = [r.split(b"\r\n\r\n", 1)[1][:-4] for r in records]
    whole = gzip.compress(b"".join(records[:2]) + b"junk" + b"".join(records[2:4]) + b"tail") + gzip.compress(records[4])
    found = list(warc.salvage(whole))
    assert [f[5] for f in found if f[0] == "record"] == blocks[:5]
    start = len(records[0] + records[1])
    assert [f[4] for f in found if f[0] == "gap"] == [(start, start + 4), (start + 4 + len(records[2] + records[3]), start + 8 + len(records[2] + records[3]))]
    for level in (0, 6):
        one = gzip.compress(b"".join(records), level)
        late = bytearray(one)
        late[-6] ^= 1
        for bad, least in ((one[:-9], 29), (bytes(late), 30), (one[:len(one) // 2], 14)):
            data = records[0] + bad + gzip.compress(records[7]) + records[8]
            found = list(warc.salvage(data))
            got = [f[5] for f in found if f[0] == "record"]
            assert got[0] == blocks[0] and got[-2:] == [blocks[7], blocks[8]] and got[1:-2] == blocks[:len(got) - 3] and len(got) - 3 >= least
            gap = [f for f in found if f[0] == "gap"]
            assert level == 0 or len(gap) == 1 and gap[0][1] == found[1][2] and gap[0][2] == len(records[0] + bad)
    (tmp_path / "a.warc.gz").write_bytes(whole)
    rows = warc.read(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sum(r["gap_reason"] is None for r in rows) == 5 and {r["content_first"] for r in rows if r["gap_reason"]} == {start, start + 4 + len(records[2] + records[3])}


def test_damage_in_files_is_logged(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(record(b"one") + b"\x00junk\x00" + record(b"two", name="b"))
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(record(b"three", name="c")) + b"\x1f\x8b\x08broken" + gzip.compress(record(b"four", name="d")))
    (tmp_path / "z.warc").write_bytes(b"")
    found = warc.read(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted(bytes(r["payload"]) for r in found if r["gap_reason"] is None) == [b"four", b"one", b"three", b"two"]
    gaps = sorted((r["file"].rsplit("/", 1)[1], r["end_byte"] - r["first_byte"], r["gap_reason"]) for r in found if r["gap_reason"])
    assert gaps == [("x.warc", 6, "version"), ("y.warc.gz", 9, "member")]
