"""WARC bundles: records, seek tables and the index, by round trip and against a plain loop."""

import base64
import hashlib
import io
import os

import pytest
import zstandard

from receivables.llm import warc_bundles as wb

# Nulls, empty and long texts, ties, repeated rows, control characters in urls, equal payloads over ids.
ROWS = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (3, "http://b/", "same"), (None, "http://c/", "same"),
    (7, "http://d/\r\nX-Page-ID: 1", "one"), (8, "http://e/", None), (10, "http://e/", ""), (11, "", "é漢\r\n\r\nWARC/1.1\r\n"), (12, "u", "x" * 300_000),
    (None, None, "lonely"), (None, None, "lonely"), (13, "u", "twice"), (13, "u", "twice"), (13, "u", "twice"), (14, "a", "tie"), (14, "b", "tie"), (-4, "n", "negative"),
    (15, "u", "same id, other text"), (15, "u", "other text"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, copy int")


def brute(rows, min_bytes=0):
    groups, out = {}, []
    for i, u, h in rows:
        groups.setdefault((h or "").encode(), []).append((i is None, i or 0, u is None, u or "", i))
    for payload, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for n, m in enumerate(sorted(members, key=lambda m: m[:4])):
            first = n == 0 or len(payload) < min_bytes
            out.append((m[4], len(payload), digest, "response" if first else "revisit", None if first else sorted(members, key=lambda m: m[:4])[0][4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    got = wb.archived_pages(table(spark, ROWS), min_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, min_bytes)
    assert wb.archived_pages(table(spark, [])).count() == 0


def test_bundles_frames_and_index(spark, scratch):
    index, folder = wb.archive(table(spark, ROWS), f"{scratch}/warc", frame_bytes=2000, bundle_bytes=400)
    rows = index.collect()
    files = sorted(os.listdir(folder))
    assert {r.bundle for r in rows} == set(files) and len(files) > 3 and len({r.record_id for r in rows}) == len(rows) == len(ROWS)
    for f in files:
        data = open(f"{folder}/{f}", "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        frames = wb.seek_table(io.BytesIO(data), len(data))
        parts = [wb.read_frame(io.BytesIO(data), x) for x in frames]
        assert b"".join(parts) == whole and sum(x[1] for x in frames) < len(data)
        for r in (r for r in rows if r.bundle == f):
            record = parts[r.frame][r.offset : r.offset + r.length]
            (headers, block), *more = wb.parsed(record)
            assert not more and headers["WARC-Record-ID"] == r.record_id and headers["WARC-Type"] == r.record_type
            assert int(headers["Content-Length"]) == len(block)
    # A small fetch reads the same bytes through the footer.
    wanted = index.where("record_type = 'revisit'").select("record_id")
    found = {r.record_id: bytes(r.record) for r in wb.fetch(index, folder, wanted).collect()}
    assert set(found) == {r.record_id for r in rows if r.record_type == "revisit"}
    assert all(f"WARC-Record-ID: {k}".encode() in v for k, v in found.items())
    # Every revisit's target is the record id of a response.
    responses = {r.record_id for r in rows if r.record_type == "response"}
    assert all(next(wb.parsed(v))[0]["WARC-Refers-To"] in responses for v in found.values())


def test_a_task_that_runs_twice_leaves_the_same_bundles(spark, scratch):
    records = wb.decided(table(spark, ROWS)).coalesce(1)
    digest = []
    for _ in range(2):
        wb.write_bundles(records, f"{scratch}/again", frame_bytes=500, bundle_bytes=100).count()
        digest.append({f: hashlib.sha256(open(f"{scratch}/again/{f}", "rb").read()).hexdigest() for f in os.listdir(f"{scratch}/again")})
    assert digest[0] == digest[1] and not any(f.startswith("_") for f in digest[0])


def test_damage_is_found(spark, scratch):
    index, folder = wb.archive(table(spark, ROWS), f"{scratch}/warc")
    name = f"{folder}/{index.first().bundle}"
    data = bytearray(open(name, "rb").read())
    frame = wb.seek_table(io.BytesIO(data), len(data))[0]
    bad = bytes([*wb.read_frame(io.BytesIO(data), frame)[:-5], *b"12345"])
    packed = zstandard.ZstdCompressor().compress(bad)
    with pytest.raises(ValueError, match="does not match"):
        wb.read_frame(io.BytesIO(packed), (0, len(packed), len(bad), frame[3]))
    with pytest.raises(ValueError, match="no seek table"):
        wb.seek_table(io.BytesIO(bytes(data[:-1]) + b"x"), len(data))
    record = wb.record_bytes("response", wb.record_name(1, "D"), 1, "u", wb.base32_digest(b"abc"), 3, b"abd", None, wb.DATE)
    with pytest.raises(ValueError, match="does not match its digest"):
        wb.described(*next(wb.parsed(record)))
