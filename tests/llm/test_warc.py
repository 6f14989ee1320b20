import gzip
import html
import json
import re
import time
import zlib
from html.parser import HTMLParser

import pytest

from gleaner.llm import warc as W

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title> A &amp; B </title><style>p{}</style>
<script>var t="</p><a href='no'>";</script></head><body><!-- <a href="no"> --><p>Eén  <b>zin</b>.</p><div>Twee<br>drie &lt;4&gt;</div>
<a class=x href="/een?a=1&amp;b=2">link</a><img src=plaatje.png></body></html>"""


def test_round_trip_and_links():
    record = W.response_record("7", "http://x.example/", PAGE.encode(), "2024-01-01T00:00:00Z")
    headers, block = W.read_record(gzip.compress(record))
    assert W.read_record(record) == (headers, block) and W.write_record([h for h in headers if h[0] != "Content-Length"], block) == record
    (kind1, meta, info), (kind2, conv, text) = W.derivatives(record)
    assert (kind1, kind2) == ("metadata", "conversion")
    source = W.get(headers, "WARC-Record-ID")
    for h in (meta, conv):
        assert W.get(h, "WARC-Refers-To") == source and W.get(h, "WARC-Target-URI") == "http://x.example/"
        assert W.get(h, "WARC-Source-Payload-Digest") == W.sha1_digest(PAGE.encode()) == W.get(headers, "WARC-Payload-Digest")
    assert W.get(meta, "WARC-Concurrent-To") == W.get(conv, "WARC-Record-ID")
    assert text.decode() == "A & B\nEén zin.\nTwee\ndrie <4>\nlink"
    found = json.loads(info)
    assert found["title"] == "A & B" and found["links"] == ["/een?a=1&b=2", "plaatje.png"] and found["payload-digest-matches"]
    assert found["source"]["WARC-Date"] == "2024-01-01T00:00:00Z" and found["http"]["Content-Type"].startswith("text/html")
    assert W.get(conv, "WARC-Block-Digest") == W.sha1_digest(text)


def test_chunked_and_zipped_entities():
    body = gzip.compress(b"<p>ok</p>")
    chunked = b"%x\r\n%s\r\n%x;q\r\n%s\r\n0\r\n\r\n" % (5, body[:5], len(body) - 5, body[5:])
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nX: a\r\n b\r\n\r\n" + chunked
    record = W.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], block)
    (_, _, info), (_, _, text) = W.derivatives(record)
    assert text == b"ok" and json.loads(info)["http"]["X"] == "a b"
    broken = W.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:2>")], b"no http")
    ((kind, headers, info),) = W.derivatives(broken)
    assert kind == "metadata" and "error" in json.loads(info) and W.get(headers, "WARC-Concurrent-To") is None
    assert list(W.derivatives(W.write_record([("WARC-Type", "request")], b""))) == []


def test_rows(spark):
    pages = [(1, "http://a.example/", PAGE), (2, None, None), (3, "http://b.example/", ""), (1, "http://a.example/", PAGE), (None, "u", "<p>" + "x " * 300_000)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, record string")
    records = W.page_responses(df)
    rows = W.build_derivatives(records, key="page_id").collect()
    assert len(rows) == 10 and sorted(r.record_type for r in rows).count("conversion") == 5
    for r in rows:
        headers, block = W.read_record(bytes(r.derived))
        assert W.get(headers, "WARC-Refers-To") == r.refers_to and len(block) == r.n_bytes and W.sha1_digest(block) == r.block_digest
    assert {r.n_bytes for r in rows if r.record_type == "conversion" and r.page_id in (2, 3)} == {0}
    bad = spark.createDataFrame([(1, b"junk"), (2, None)], "page_id long, record binary")
    assert [r.record_type for r in W.build_derivatives(bad, key="page_id").collect()] == ["metadata", "metadata"]
    assert W.build_derivatives(records.limit(0), key="page_id").count() == 0


def response(http: bytes, body: bytes, *more):
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), *more]
    return W.write_record(headers, b"HTTP/1.1 200 OK\r\n" + http + b"\r\n" + body)


def test_repeated_headers_all_stay_in_order():
    record = response(b"Set-Cookie: a=1\r\nVia: x\r\nSet-Cookie: b=2\r\n", b"<p>ok</p>", ("WARC-Concurrent-To", "<urn:uuid:2>"), ("WARC-Concurrent-To", "<urn:uuid:3>"))
    info = json.loads(next(W.derivatives(record))[2])
    assert info["http-headers"] == [["Set-Cookie", "a=1"], ["Via", "x"], ["Set-Cookie", "b=2"]]
    assert [list(h) for h in W.read_record(record)[0]] == info["source-headers"]
    assert [v for k, v in info["source-headers"] if k == "WARC-Concurrent-To"] == ["<urn:uuid:2>", "<urn:uuid:3>"]


@pytest.mark.parametrize("coding,body", [
    ("deflate", zlib.compress(b"<p>ok</p>")), ("Deflate", zlib.compress(b"<p>ok</p>")[2:-4]), ("x-gzip", gzip.compress(b"<p>ok</p>")),
    ("deflate, gzip", gzip.compress(zlib.compress(b"<p>ok</p>"))), ("identity", b"<p>ok</p>"),
])
def test_known_codings(coding, body):
    (_, _, info), (_, _, text) = W.derivatives(response(f"Content-Encoding: {coding}\r\n".encode(), body))
    assert text == b"ok" and "error" not in json.loads(info)


@pytest.mark.parametrize("coding,body", [("br", b"\x0b\x02\x80<p>ok</p>\x03"), ("gzip, br", b"x"), ("deflate", b"junk"), ("gzip", gzip.compress(b"<p>ok</p>")[:10] + b"\xff" * 9)])
def test_other_codings_are_noted(coding, body):
    ((kind, _, info),) = W.derivatives(response(f"Via: x\r\nContent-Encoding: {coding}\r\n".encode(), body))
    info = json.loads(info)
    assert kind == "metadata" and info["error"] and ["Via", "x"] in info["http-headers"] and "title" not in info


def test_the_query_returns_the_records(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.example/", PAGE), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = W.op4_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(p, k) for p in (1, 2) for k in ("conversion", "metadata")]
    blocks = {(r.page_id, r.record_type): W.read_record(bytes(r.derived)) for r in rows}
    assert blocks[1, "conversion"][1].decode() == "A & B\nEén zin.\nTwee\ndrie <4>\nlink"
    assert W.get(blocks[1, "metadata"][0], "WARC-Concurrent-To") == W.get(blocks[1, "conversion"][0], "WARC-Record-ID")
    assert json.loads(blocks[1, "metadata"][1])["title"] == "A & B"


@pytest.mark.parametrize("opening", ["<a x ", "<script ", "<script>", "<!", "<!--", "<title>", "<a href=", "<a href='", '<a b="', "<a b='>\"", "</p", "<", "<p", "&", "<title></title"])
def test_any_markup_is_linear(opening):
    page = opening * (1_000_000 // len(opening))
    began = time.time()
    W.read_page(page)
    W.read_page(page + ">")
    assert time.time() - began < 4


class Reader(HTMLParser):
    """The standard library's parser on well-formed pages, as a second statement of what a page shows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in W.HIDDEN
        if not self.hidden:
            self.out.append("\n" if tag in W.BREAKS else "")
            self.links += [v.strip() for k, v in attrs if tag in W.LINKING and k in ("href", "src")][:1]

    def handle_endtag(self, tag):
        if not self.hidden:
            self.out.append("\n" if tag in W.BREAKS else "")
        self.hidden -= tag in W.HIDDEN

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_pages_against_the_standard_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    for page in [*pages, PAGE]:
        other = Reader()
        other.feed(page or "")
        other.close()
        lines = (" ".join(x.split()) for x in "".join(other.out).split("\n"))
        title, links, text = W.read_page(page or "")
        assert (links, text) == (other.links, "\n".join(x for x in lines if x))
        found = re.search(r"<title[^>]*>(.*?)</title>", page or "", re.S)
        assert title == (" ".join(html.unescape(found[1]).split()) if found else "")


def test_a_quoted_bracket_does_not_end_a_tag():
    assert W.read_page('<a title="a>b" href="/x">t</a><p title=\'>\'>u') == ("", ["/x"], "t\nu")
    assert W.read_page('<a title="a>t</a> 1 < 2 <b>c')[2] == "t 1 < 2 c"


def test_an_unreadable_record_keeps_its_id_and_headers():
    whole = response(b"", b"<p>ok</p>" * 500, ("WARC-Target-URI", "http://x.example/"))
    for broken in (whole[:300], gzip.compress(whole)[:-20]):
        ((kind, headers, info),) = W.derivatives(broken)
        assert kind == "metadata" and W.get(headers, "WARC-Refers-To") == "<urn:uuid:1>" and W.get(headers, "WARC-Target-URI") == "http://x.example/"
        assert json.loads(info)["error"] and ["WARC-Target-URI", "http://x.example/"] in json.loads(info)["source-headers"]
    ((_, headers, info),) = W.derivatives(b"junk")
    assert json.loads(info)["error"] and W.get(headers, "WARC-Refers-To") is None and W.get(headers, "WARC-Record-ID")


def test_files(spark, tmp_path):
    records = [W.response_record(str(i), f"http://{i}.example/", b"<p>%d</p>" % i, "2024-01-01T00:00:00Z") for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[3:])) + b"junk")
    rows = W.build_derivatives(W.read_warc(spark, str(tmp_path)), key="number").collect()
    assert sorted(W.read_record(bytes(r.derived))[1] for r in rows if r.record_type == "conversion") == [b"0", b"1", b"2", b"3", b"4"]
    assert sum("error" in json.loads(W.read_record(bytes(r.derived))[1]) for r in rows if r.record_type == "metadata") == 1
