from __future__ import annotations

import base64
import gzip
import hashlib

from ledgermesh.llm import warc

SCHEMA = "page_id long, url string, html string, value string"


def digest(text: str) -> str:
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def pages() -> list[tuple]:
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    return [
        (1, "http://a/x", "<p>same</p>", "c"), (2, "http://b", "<p>same</p>", "c"), (3, "http://c\r\nWARC-Type: x", "<p>same</p>", "c"),
        (3, "http://c2", "<p>same</p>", "c"), (4, None, None, None), (5, "u", "", "c"), (6, "u", fake * 3, "c"),
        (7, "u", "é" * 50_000, "c"), (None, "u", "<p>same</p>", "c"), (None, "u", "alone", "c"), (8, "u", "\r\n\r\n", "c"),
    ]


def written(spark, folder, rows, **settings) -> str:
    path = str(folder)
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, **settings)
    return path


def rows_read(spark, path):
    return warc.read_archives(spark, path).withColumn("page", warc.page_of("record_id")).withColumn("to", warc.page_of("refers_to")).collect()


def test_round_trip_with_revisits(spark, tmp_path):
    read = rows_read(spark, written(spark, tmp_path / "w", pages()))
    assert {r.kind for r in read} == {"record"} and len(read) == len(pages())
    got = sorted((r.page or 0, r.payload_bytes, r.payload_digest, r.warc_type, r.to) for r in read)
    expected = []
    for page, _, html, _ in pages():
        html = html or ""
        largest = max((p for p, _, h, _ in pages() if (h or "") == html and p is not None), default=None)
        revisit = page is not None and largest is not None and page < largest
        expected.append((page or 0, len(html.encode()), digest(html), "revisit" if revisit else "response", largest if revisit else None))
    assert got == sorted(expected, key=lambda r: (r[0], r[1]))
    by_page = {r.page: r for r in read}
    assert by_page[6].payload.decode() == pages()[6][2] and by_page[2].payload == b"" and by_page[7].target_uri == "u"


def test_round_trip_of_urls_with_unicode_line_ends(spark, tmp_path):
    urls = [f"http://a/{mark}b{rest}{mark}" for mark in ("\x85", "\u2028", "\u2029", "\xa0") for rest in ("", ":c", ": c")]
    rows = [(k, url, f"page {k // 2}", "c") for k, url in enumerate(urls)]
    read = rows_read(spark, written(spark, tmp_path / "w", rows))
    assert {r.kind for r in read} == {"record"}
    assert {r.page: r.target_uri for r in read} == {k: url.replace(" ", "") for k, url, *_ in rows}


def test_small_payloads_are_responses(spark, tmp_path):
    read = rows_read(spark, written(spark, tmp_path / "w", pages(), least_bytes=100))
    assert {r.warc_type for r in read} == {"response"}
    read = rows_read(spark, written(spark, tmp_path / "none", []))
    assert read == []


def archive(n: int = 5) -> tuple[list[bytes], bytes]:
    records = []
    for k in range(n):
        body = f"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\npayload {k}"
        coded = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        records.append((
            f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nContent-Type: application/http\r\n"
            f"WARC-Block-Digest: sha1:{coded}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
        ).encode())
    return records, b"".join(records)


def check(data: bytes, expected: list[int], gaps: list[tuple[int, int]]) -> None:
    found = list(warc.salvage(data))
    ends = [0, *[o + n for o, n, *_ in found]]
    assert [f[0] for f in found] == ends[:-1] and ends[-1] == len(data)
    assert [int(f[4]["warc-record-id"][12:-1]) for f in found if f[2] == "record"] == expected
    assert [(f[0], f[1]) for f in found if f[2] == "gap"] == gaps


def test_salvage_of_plain_files():
    records, data = archive()
    n = [len(r) for r in records]
    check(data, [0, 1, 2, 3, 4], [])
    check(data.replace(b"payload 1", b"payl\x00ad 1"), [0, 2, 3, 4], [(n[0], n[1])])  # digest
    check(data[:-20], [0, 1, 2, 3], [(sum(n[:4]), n[4] - 20)])  # cut off
    check(b"junk" + data, [0, 1, 2, 3, 4], [(0, 4)])
    check(data[: n[0] + 60] + data[n[0] + n[1] :], [0, 2, 3, 4], [(n[0], 60)])  # a hole
    check(records[0] + records[1].replace(b"Content-Length: 4", b"Content-Length: 9", 1) + records[2], [0, 2], [(n[0], n[1])])
    check(records[0] + b"\x1f\x8b\x08 no member" + records[1], [0, 1], [(n[0], 13)])
    check(b"\x00" * 1000, [], [(0, 1000)])
    check(b"", [], [])


def test_salvage_of_compressed_members():
    records, _ = archive()
    members = [gzip.compress(r, mtime=0) for r in records]
    n = [len(m) for m in members]
    check(b"".join(members), [0, 1, 2, 3, 4], [])
    broken = bytearray(members[2])
    broken[20] ^= 255
    check(b"".join([*members[:2], bytes(broken), *members[3:]]), [0, 1, 3, 4], [(n[0] + n[1], n[2])])
    check(b"".join([members[0], members[1][:30], members[2]]), [0, 2], [(n[0], 30)])
    check(b"".join([members[0], records[1], members[2]]), [0, 1, 2], [])


def test_gap_log(spark, tmp_path):
    _, data = archive()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(b"junk" + data)
    (tmp_path / "in" / "empty.warc").write_bytes(b"")
    read = warc.read_archives(spark, str(tmp_path / "in"))
    assert read.filter("kind = 'record'").count() == 5
    warc.log_gaps(read, str(tmp_path / "gaps"))
    gap = spark.read.json(str(tmp_path / "gaps")).collect()
    assert [(g.offset, g.length, g.reason) for g in gap] == [(0, 4, "no version line")]
