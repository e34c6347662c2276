import base64
import hashlib
import os
import struct

import pytest
import zstandard

from quillstack.llm.warc import dictionary_frame, frame_end, parse_record, read_archive, read_archives, record, warc_round_trip


def test_round_trip_against_a_plain_reference(spark):
    big, bigger = "é" * 600, "<p>" + "x y z " * 60_000
    data = [(1, "http://a/1", big, 1), (2, "http://a/2", big, 1), (3, None, big, 1), (4, "u\r\nv", "short", 1), (5, "u", "short", 1), (6, "u", None, 1), (None, "u", big, 1), (7, "u", bigger, 1), (8, "u", bigger, 1), (8, "u", bigger, 1)]
    data += [(100 + i, f"http://b/{i}", f"<html><body>page {i} " + "words and words " * 80, i) for i in range(60)]
    got = warc_round_trip(spark.createDataFrame(data, "page_id long, url string, html string, payload int")).collect()
    assert len(got) == len(data)
    tops = {}
    for i, _, html, _ in data:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            tops[body] = max(tops.get(body, -1), i)
    bodies = {i: (html or "").encode() for i, _, html, _ in data}
    responses = {}
    for r in got:
        body = bodies[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
        if r.record_type == "response":
            assert bytes(r.payload) == body and r.refers_to is None
            responses[body] = responses.get(body, 0) + 1
        else:
            assert r.payload is None and r.refers_to == tops[body]
    assert all(responses[b] == 1 for b in tops) and responses[b"short"] == 2
    assert {r.url for r in got if r.page_id in (3, 4)} == {"", "u%0D%0Av"}


def test_no_pages(spark):
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_frames_of_all_kinds():
    for data in (b"", b"a" * 10, b"a" * 500_000, os.urandom(300_000), b"ab" * 70_000):
        for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
            frame = zstandard.ZstdCompressor(**options).compress(data)
            assert frame_end(frame + b"more", 0) == len(frame)
            with pytest.raises((ValueError, struct.error, IndexError)):
                frame_end(frame[:-1], 0)


def test_records_are_validated():
    good = record("1", "u", b"body", hashlib.sha1(b"body").hexdigest(), None)
    assert parse_record(good)[1] == b"body"
    for bad in (good[:-1], good + b"x", good.replace(b"body", b"bodi"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"WARC-Data"), good.replace(b"Content-Type:", b"Content-Type")):
        with pytest.raises(ValueError):
            parse_record(bad)
    with pytest.raises(ValueError):
        list(read_archive(zstandard.compress(good) + b" " * 20))
    revisit = parse_record(record("2", "v", b"body", hashlib.sha1(b"body").hexdigest(), "1", "u"))[0]
    assert revisit["warc-refers-to"] == parse_record(good)[0]["warc-record-id"] and revisit["warc-refers-to-target-uri"] == "u"
    assert [b for _, b in read_archive(dictionary_frame(b"") + zstandard.compress(good) * 2)] == [b"body", b"body"]


def foreign(kind="response", body=b"", **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2020-01-01T00:00:00Z", **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(body)}
    return "\r\n".join(["WARC/1.0", *(f"{k}: {v}" for k, v in head.items())]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """Streamed frames without a size or a dictionary; records without this writer's headers."""
    page = b"<p>payload"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    sha = base64.b32encode(hashlib.sha1(page).digest()).decode()
    records = [
        foreign("warcinfo", b"software: x", Content_Type="application/warc-fields"),
        foreign("response", http, Content_Type="application/http; msgtype=response", WARC_Target_URI="http://a/", WARC_Payload_Digest=f"sha1:{sha}"),
        foreign("response", http, Content_Type="application/http;msgtype=response", WARC_Target_URI="http://b/"),
        foreign("revisit", b"", WARC_Target_URI="http://c/", WARC_Refers_To="<urn:uuid:1>", WARC_Payload_Digest="md5:1"),
    ]
    coder = zstandard.ZstdCompressor(write_content_size=False)
    streamed = b""
    for r in records:
        part = coder.compressobj()
        streamed += part.compress(r) + part.flush()
    for n, data in enumerate((streamed, dictionary_frame(b"") + streamed)):
        (tmp_path / f"{n}.warc.zst").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.zst",) for n in (0, 1)], "path string")
    got = sorted(((r.url or "", r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.payload), r.page_id) for r in read_archives(files).collect()), key=repr)
    want = [
        ("", "warcinfo", 11, None, None, b"software: x", None), ("http://a/", "response", len(page), hashlib.sha1(page).hexdigest(), None, page, None),
        ("http://b/", "response", len(page), None, None, page, None), ("http://c/", "revisit", 0, "md5:1", "<urn:uuid:1>", b"", None),
    ]
    assert got == sorted(want * 2, key=repr)
    with pytest.raises(ValueError):
        parse_record(foreign("response", http, Content_Type="application/http", WARC_Payload_Digest="sha1:" + "A" * 32))


def test_urls_come_back(spark):
    rows = [(1, " http://a ", "x"), (2, "  b", "x"), (3, "http://c/d e", "x")]
    got = {r.page_id: r.url for r in warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "%20http://a%20", 2: "%20 b", 3: "http://c/d e"}
