"""Archives: written and read back against a plain version, and hand-made ones assembled."""

import base64
import gzip
import hashlib
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.llm import warc
from tidewire.llm.common import written


def plain(rows):
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = Counter()
    for html, pages in groups.items():
        data = html.encode()
        pages = sorted(pages, key=lambda p: (p is not None, p), reverse=True)
        for i, page in enumerate(pages):
            again = len(data) >= 1000 and i > 0
            out[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", pages[0] if again else None] += 1
    return out


def listed(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def table_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "content": F.lit("x"), "payload": F.lit(2), "first": F.lit(3), "record_id": F.lit("y")})


def test_pages(spark):
    rng = random.Random(4)
    htmls = ["x" * 999, "x" * 1000, "é" * 500, "é" * 499 + "e", "", None, "<p>\r\n\r\nWARC/1.1\r\n</p>" * 70, "y" * 3_000_000]
    rows = [(i if rng.random() < 0.97 else None, rng.choice(["http://a.org/b?c", None, "no scheme", "http://a.org/\r\nx y\tz", "ftp://é"]), rng.choice(htmls[:7])) for i in range(200)]
    rows += [(7, "http://u", htmls[7]), (9, "http://u", htmls[7])]
    rows += [rows[3], rows[4], *[(500, "http://t", htmls[1])] * 3, (500, None, htmls[1]), *[(None, None, None)] * 2]
    assert listed(warc.archive_pages(table_of(spark, rows))) == plain(rows)


def test_hot_payload(spark):
    rows = [(i, f"http://h/{i}", "z" * 2000 if i % 3 else f"{i}" * 400) for i in range(1500)]
    assert listed(warc.archive_pages(table_of(spark, rows))) == plain(rows)


def test_empty(spark):
    assert warc.archive_pages(table_of(spark, [])).count() == 0


def record(kind, record_id, block=b"", **fields):
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>" if record_id else None, **{k.replace("_", "-"): v for k, v in fields.items()}, "Content-Length": len(block)}
    lines = [f"{k}: {x}" for k, v in named.items() if v is not None for x in (v if isinstance(v, list) else [v])]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = {"Content_Type": "application/http; msgtype=response"}
BODY = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\nbody\r\n\r\n"


def of(ids):
    return [f"<{i}>" for i in ids.split()]


RECORDS = [
    record("warcinfo", "w", b"software: x\r\n", Content_Type="application/warc-fields"),
    record("response", "r1", BODY, WARC_Target_URI="http://a/", WARC_Concurrent_To=of("q1"), **HTTP),
    record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),  # linked from the response
    record("metadata", "m1", b"k: 1\r\nlong: a\r\n b\r\nk: 2\r\n", Content_Type="application/warc-fields", WARC_Concurrent_To=of("q1")),  # two steps away
    record("metadata", "m2", b"free text", WARC_Concurrent_To=of("m1 q1")),
    record("revisit", "r2", b"HTTP/1.1 200 OK\r\nContent-Length: 8\r\n\r\n", WARC_Concurrent_To=of("q2 missing"), WARC_Refers_To="<r1>", WARC_Payload_Digest="sha1:" + base64.b32encode(hashlib.sha1(b"body\r\n\r\n").digest()).decode(), **HTTP),
    record("request", "q2", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To=of("r2 r1"), Content_Type="application/http; msgtype=request"),  # of two, the smaller
    record("request", "q3", b"", WARC_Concurrent_To=of("m3")),
    record("metadata", "m3", b"", WARC_Concurrent_To=of("q3 m3")),  # no response: a capture of its own
    record("resource", None, b"plain"),
    record("response", "r1", b"again", WARC_Target_URI="http://b/"),  # repeats an id
]


@pytest.mark.parametrize("packed", ["members", "one member", "plain"])
def test_assembly(spark, tmp_path, packed):
    data = {"members": b"".join(gzip.compress(r) for r in RECORDS), "one member": gzip.compress(b"".join(RECORDS)), "plain": b"".join(RECORDS)}[packed]
    (tmp_path / ("a.warc" if packed == "plain" else "a.warc.gz")).write_bytes(data)
    records = written(warc.read_records(spark, str(tmp_path), payload=True))
    assert [r.type for r in records.orderBy("place").collect()] == ["warcinfo", "response", "request", "metadata", "metadata", "revisit", "request", "request", "metadata", "resource", "response"]
    got = {r.capture_id: r for r in warc.captures(records).collect()}
    assert {k: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for k, r in got.items() if "#9" not in k} == {"r1": (["q1", "q2"], ["m1", "m2"]), "r2": ([], []), "m3": (["q3"], ["m3"])}
    assert len(got) == 4 and got["m3"].response is None
    r1 = got["r1"].response
    assert (r1.target_uri, bytes(r1.payload), r1.payload_bytes, r1.payload_digest) == ("http://a/", b"body\r\n\r\n", 8, hashlib.sha1(b"body\r\n\r\n").hexdigest())
    assert got["r2"].response.claimed_digest == r1.payload_digest and got["r2"].response.refers_to == "r1"
    assert warc.captures(records).filter("capture_id = 'r1'").select(warc.field("metadata", "k"), warc.field("metadata", "long"), warc.field("metadata", "none")).first()[:] == ("1", "a b", None)


def test_small_reads_and_broken_files(monkeypatch):
    data = b"".join(gzip.compress(r) for r in RECORDS)
    want = list(warc.parse(io.BytesIO(data), True))
    for chunk in (1, 7, 64):
        monkeypatch.setattr(warc, "_CHUNK", chunk)
        assert list(warc.parse(io.BytesIO(data), True)) == want
        assert list(warc.parse(io.BytesIO(b"".join(RECORDS)), True)) == want
    for broken in (data[:-9], b"".join(RECORDS)[:-20], b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            list(warc.parse(io.BytesIO(broken), True))
