"""Archives: round trips, transactions, revisits, damage."""

import base64
import gzip
import hashlib
import random

import pytest

from lakeveil.llm import warc
from lakeveil.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, digest string, rid int, salt int"


def page_table(spark, rows, parts=3):
    return spark.createDataFrame([(i, u, h, "mine", 1, 2) for i, u, h in rows], SCHEMA).repartition(parts)


def plain(rows, least):
    first: dict = {}
    for i, _, h in rows:
        h = (h or "").encode()
        first.setdefault(h, []).append((i is None, i))
    out, used = [], set()
    for i, _, h in rows:
        h = (h or "").encode()
        main = min(first[h], key=lambda x: (x[0], x[1] or 0))
        again = len(h) >= least and ((i is None, i) != main or h in used)
        if (i is None, i) == main:
            used.add(h)
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", main[1] if again else None))
    return sorted(out, key=str)


TRICKY = [
    (1, "http://a.example/x?y#z", "<p>one</p>"),
    (2, None, None),
    (3, "", ""),
    (4, "http://a.example", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\n"),
    (5, "http://a.example/\r\nWARC-Type: evil", "\r\n\r\n\r\n\r\n"),
    (6, "http://ä.example/ü?q=1 2", "ü€😀\x00\x01" * 3),
    (None, "http://b.example/n", "<p>one</p>"),
    (None, "http://b.example/m", "<p>alone</p>"),
    (8, "no address", "\n"),
]


@pytest.mark.parametrize("least,compression", [(0, "gzip"), (11, "none")])
def test_round_trip_equals_plain_version(spark, least, compression):
    rng = random.Random(3)
    rows = TRICKY + [(100 + i, f"http://h{i % 3}.example/{i}", rng.choice(["hot", "warm " * 5, f"own {i} " * 400])) for i in range(60)] + [(103, "http://again.example", "hot"), (100, "u", "first"), (100, "u", "first"), (7, "v", "x" * 300_000)]
    caps = warc.page_captures(page_table(spark, rows), least=least, compression=compression)
    found = caps.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page) for r in found), key=str) == plain(rows, least)
    assert all(r.problem is None and len(r.requests) == len(r.metadata) == 1 and r.http_status == 200 for r in found)
    texts = sorted(bytes(r.payload).decode() for r in found if r.record_type == "response")
    assert sorted({h or "" for _, _, h in rows}) == sorted(set(texts))
    by_id = {r.page_id: r for r in found}
    assert by_id[5].target_uri == "http://a.example/%0D%0AWARC-Type:%20evil" and by_id[2].target_uri is None
    assert bytes(by_id[1].requests[0].payload) == b"" and by_id[1].target_uri == "http://a.example/x?y#z"


def test_no_pages(spark):
    assert warc.page_captures(page_table(spark, [])).collect() == []


def record(kind, name, block=b"", **headers):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, values in headers.items() for v in (values if isinstance(values, list) else [values]))
    return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: {name}\r\n{head}content-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_transactions_in_either_direction(spark, tmp_path):
    http = dict(Content_Type="application/http; msgtype=response")
    body = b"HTTP/1.1 404 Not Found\r\nX-A: 1\r\n\r\nbody"
    folder = tmp_path / "in"
    folder.mkdir()
    one = record("warcinfo", "<i>", b"software: x") + record("response", "<r1>", body, **http) + record("request", "<q1>", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", WARC_Concurrent_To="<r1>", Content_Type="application/http")
    two = record("request", "<q2>", WARC_Concurrent_To="<nowhere>") + record("response", "<r2>", body, WARC_Concurrent_To=["<q2>", "<m0>"], **http)
    far = record("metadata", "<m2>", b"a: 1\r\nb: 2", WARC_Concurrent_To="<q2>", Content_Type="application/warc-fields") + record("metadata", "<m3>", WARC_Concurrent_To="<lost>") + record("response", "<r3>", body, **http)
    (folder / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two[:40] + two[40:]))
    (folder / "b.warc").write_bytes(far + record("response", "<r3>", body, **http) + record("revisit", "<v>", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", WARC_Refers_To="<r3>", **http))
    caps = warc.assemble(warc.read_records(spark, f"file://{folder}"))
    got = {r.record_id: ([q.record_id for q in r.requests], [m.record_id for m in r.metadata], r.http_status, r.payload_bytes) for r in caps.collect()}
    assert got == {"<r1>": (["<q1>"], [], 404, 4), "<r2>": (["<q2>"], ["<m2>"], 404, 4), "<r3>": ([], [], 404, 4), "<v>": ([], [], 200, 9)}
    named = warc.resolved(caps, caps.record_id, "to").where("to is not null").collect()
    assert [(r.record_id, r.to) for r in named] == [("<v>", "<r3>")]


def test_damage_is_reported_and_other_files_are_read(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = record("response", "<g>", b"text")
    bad = record("response", "<b>", b"text", WARC_Payload_Digest="sha1:AAAA", Content_Type="text/html")
    (folder / "good.warc").write_bytes(good + bad)
    (folder / "cut.warc").write_bytes(good.replace(b"<g>", b"<h>") + good[:-7])
    (folder / "cut.warc.gz").write_bytes(gzip.compress(good * 50)[:-9])
    (folder / "junk.warc").write_bytes(b"hello world\r\n\r\n")
    (folder / "empty.warc").write_bytes(b"")
    rows = warc.read_records(spark, f"file://{folder}").collect()
    assert sum(r.record_type == "invalid" for r in rows) == 3
    assert {r.record_id for r in rows if r.problem is None} >= {"<g>", "<h>"}
    assert [r.record_id for r in rows if r.problem and r.record_type == "response"] == ["<b>"]


def test_hot_payload_is_dealt_out(spark):
    """Half of all pages are one: one response, all others refer to it."""
    rows = [(i, "u", "same" if i % 2 else f"p{i}") for i in range(400)]
    caps = warc.page_captures(page_table(spark, rows)).groupBy("record_type", "refers_to_page").count().collect()
    assert sorted((r.record_type, r.refers_to_page, r["count"]) for r in caps) == [("response", None, 201), ("revisit", 1, 199)]


def test_numbers_of_captures_are_written_once(spark):
    scratch = Scratch(spark, "test-warc")
    df = warc.captures(scratch, page_table(spark, [(1, "a", "x"), (2, "b", "x")]), 0, "page_id", "url", "html")
    rows = {r.page_id: r for r in df.collect()}
    assert rows[2].refers_rid == rows[1].rid and rows[1].refers_rid is None
