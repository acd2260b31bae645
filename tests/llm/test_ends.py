"""A version line at the end of a payload or of a chunk."""

import gzip
import hashlib
import re

import pytest
from catalume.llm import warc


@pytest.mark.parametrize("html", ["ends in WARC/1.1", "WARC/1.1", "x" * 24 + "WARC/1.1 goes on", "x" * 24 + "WARC/1.1WARC/1.1\r\nWARC/1.1", "aWARC/1.1\r\n", "", None])
def test_version_at_an_end(spark, tmp_path, html):
    """Chunks of 32 bytes: the version stands at a payload's end, at a chunk's end, and before a line break."""
    pages = spark.createDataFrame([(1, "http://a.example/", html), (2, "http://b.example/", "plain")], "page_id long, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w", chunk_bytes=32)
    found = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.read_records(spark, f"{tmp_path}/w").collect()}
    raw = (html or "").encode()
    assert found == {1: (len(raw), hashlib.sha1(raw).hexdigest()), 2: (5, hashlib.sha1(b"plain").hexdigest())}


@pytest.mark.parametrize("size", [0, 31, 32, 33, 64, 200])
def test_total_length_of_segments(spark, tmp_path, size):
    """The last segment of a record, and no other, has the length of all its segments' blocks."""
    pages = spark.createDataFrame([(1, "http://a.example/", "x" * size)], "page_id long, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w", chunk_bytes=32)
    text = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(tmp_path.glob("w/*.gz"))).decode()
    heads = [head for head in re.findall(r"WARC/1\.1\r\n.*?\r\n\r\n", text, re.S)]
    field = lambda name: [int(m[1]) if (m := re.search(rf"\r\n{name}: (\d+)\r\n", h)) else None for h in heads]
    lengths, numbers, totals = field("Content-Length"), field("WARC-Segment-Number"), field("WARC-Segment-Total-Length")
    if size <= 32:
        assert numbers == totals == [None]
    else:
        assert numbers == [*range(1, len(heads) + 1)] and totals == [*[None] * (len(heads) - 1), sum(lengths)]


def test_popular_payload(spark, tmp_path, none):
    """Many pages of one payload, null and repeated ids, and columns whose names operators use."""
    body = "<p>" + "popular " * 200
    rows = [(i, f"http://a.example/{i}", body, "x") for i in range(200)] + [(199, "http://b.example/", body, "y"), (None, None, body, "z"), (None, "u", "short", None), (7, None, "é" * 700, "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    found = [tuple(r) for r in warc.op9_warc(spark, pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    wanted = [(i, len(body), "revisit", 199) for i in range(199)] + [(199, len(body), "response", None)] * 2 + [(None, len(body), "revisit", 199), (None, 5, "response", None), (7, 1400, "response", None)]
    assert sorted(found, key=str) == sorted(wanted, key=str)
