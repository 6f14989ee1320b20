"""WARC derivatives: from each response record a metadata record and a plain-text conversion record.

Both refer to the response by its record id, carry its target, date and payload digest, and keep the source's WARC and
HTTP headers in the metadata: as ordered pairs of all (source-headers, http-headers) and, for look-ups, by name with the last
value (source, http). Record ids of derivatives are made from the response's id, so a repeated run names them alike.

Scale: one pass, record by record, no shuffle; markup is read in one walk, in time proportional to the page whatever it
holds. A record that cannot be read, or whose entity has a coding other than gzip and deflate, gives a metadata
record that says so, with the record's id and headers as far as they can be read, and no conversion.

Defined results: a null or empty page is a response with an empty body and an empty conversion; records of other types
than response pass unmentioned; repeated records are each converted, under the same ids; a very long page is one record like any
other; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

VERSION = "WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

Headers = list[tuple[str, str]]


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def write_record(headers: Headers, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def read_headers(data: bytes) -> tuple[str, Headers, bytes]:
    """First line, headers (folded lines joined), and what follows the empty line."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of headers")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
        else:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"no header: {line[:60]!r}")
            headers.append((name.strip(), value.strip()))
    return first, headers, rest


def get(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def read_record(data: bytes) -> tuple[Headers, bytes]:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    first, headers, rest = read_headers(data)
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    size = int(get(headers, "Content-Length") or -1)
    if not 0 <= size <= len(rest):
        raise ValueError("record shorter than its Content-Length")
    return headers, rest[:size]


def salvaged_headers(data: bytes) -> Headers:
    """The WARC headers of a record that cannot be read whole, as far as they go."""
    try:
        if data[:2] == b"\x1f\x8b":
            data = zlib.decompressobj(wbits=31).decompress(data)
        first, headers, _ = read_headers(data)
    except (ValueError, zlib.error):
        return []
    return headers if first.startswith("WARC/") else []


def split_records(data: bytes) -> Iterator[bytes]:
    """The records of a WARC file, plain or with a gzip member for each; what cannot be split is one last record."""
    while data:
        if data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(wbits=31)
            try:
                body = member.decompress(data) + member.flush()
            except zlib.error:
                yield data
                return
            yield body if member.eof else data
            data = member.unused_data
            continue
        try:
            _, headers, rest = read_headers(data)
            size = int(get(headers, "Content-Length") or -1)
        except ValueError:
            size = -1
        if not 0 <= size <= len(rest):
            yield data
            return
        end = len(data) - len(rest) + size
        yield data[:end]
        data = data[end:].lstrip(b"\r\n")


def dechunk(body: bytes) -> bytes:
    out = []
    while True:
        size, found, body = body.partition(b"\r\n")
        n = int(size.split(b";")[0], 16) if found else 0
        if not n:
            return b"".join(out)
        out.append(body[:n])
        body = body[n + 2 :]


def http_payload(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and the decoded entity of an HTTP response."""
    first, headers, body = read_headers(block)
    return first, headers, entity(headers, body)


def entity(headers: Headers, body: bytes) -> bytes:
    """The body without its transfer and content codings, the last applied first; ValueError for one that is not known."""
    for name in ("Transfer-Encoding", "Content-Encoding"):
        codings = [c.strip().lower() for k, v in headers if k.lower() == name.lower() for c in v.split(",")]
        for coding in reversed(codings):
            if coding == "chunked" and name == "Transfer-Encoding":
                body = dechunk(body)
            elif coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                body = inflate(body)
            elif coding not in ("", "identity"):
                raise ValueError(f"{name} {coding} is not supported")
    return body


def inflate(body: bytes) -> bytes:
    """A deflate entity, with the zlib header or, as some servers send it, without."""
    try:
        return zlib.decompress(body)
    except zlib.error:
        return zlib.decompress(body, -zlib.MAX_WBITS)


TAG_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*+)")
#: the rest of a tag up to its ">", one in a quoted value does not count
TAG_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
ADDRESS = re.compile(r"""\b(?:href|src)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements without visible text, elements that link, and elements that end a line.
HIDDEN = frozenset("script style noscript template".split())
LINKING = frozenset("a link img iframe area".split())
BREAKS = frozenset(
    """p div br li ul ol table tr h1 h2 h3 h4 h5 h6 nav header footer section article aside main blockquote pre hr form dl dt dd
    head body title""".split()
)
CLOSING = {name: re.compile(rf"</{name}\s*+>", re.I) for name in (*HIDDEN, "title")}
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)


def decoded(body: bytes, content_type: str | None) -> str:
    found = CHARSET.search(content_type or "") or CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def read_page(page: str) -> tuple[str, list[str], str]:
    """Title, links in order, and visible text: a line for each block, white space inside a line collapsed.

    One walk over the page that never goes back: what is opened and not closed is read once to the end, and where no ">" is
    left the rest is text. Markup of any kind so takes time in proportion to the page.
    """
    out: list[str] = []
    links: list[str] = []
    title, titled, quoted, at = "", False, True, 0
    while (lt := page.find("<", at)) >= 0:
        out.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        name = TAG_NAME.match(page, lt)
        if not name and not page.startswith(("<!", "<?"), lt):
            out.append("<")
            at = lt + 1
            continue
        rest = TAG_REST.match(page, name.end()) if name and quoted else None
        end = rest.end() if rest else page.find(">", lt) + 1
        quoted &= bool(rest) or not name
        if not end:
            at = lt
            break
        at = end
        if not name:
            continue
        opens, kind = page[lt + 1] != "/", name[1].lower()
        if kind in HIDDEN:
            closed = CLOSING[kind].search(page, end) if opens else None
            at = closed.end() if closed else len(page) if opens else end
        elif kind in BREAKS:
            out.append("\n")
            if kind == "title" and opens and not titled:
                titled, closed = True, CLOSING[kind].search(page, end)
                title = " ".join(html.unescape(page[end : closed.start()]).split()) if closed else ""
        elif kind in LINKING and opens and (found := ADDRESS.search(page, name.end(), end)):
            links.append(html.unescape(found[1] or found[2] or found[3] or "").strip())
    out.append(page[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return title, links, "\n".join(x for x in lines if x)


def response_record(page_id: str, url: str, page: bytes, date: str) -> bytes:
    """The response record of a page as fetched."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(page)
    block = http + page
    return write_record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id, url)), ("WARC-Date", date), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", sha1_digest(page)), ("WARC-Block-Digest", sha1_digest(block)), ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


READ_ERRORS = (ValueError, OSError, EOFError, zlib.error)


def derivatives(record: bytes) -> Iterator[tuple[str, Headers, bytes]]:
    """(type, headers, block) of the metadata record and, for readable responses, of the conversion record.

    A record that cannot be read gives a metadata record with the error and with what its headers still tell.
    """
    broken = None
    try:
        headers, block = read_record(record)
    except READ_ERRORS as e:
        headers, block, broken = salvaged_headers(record), b"", e
    if not broken and get(headers, "WARC-Type") != "response":
        return
    source = get(headers, "WARC-Record-ID") or ""
    shared = [(k, v) for k, v in (("WARC-Target-URI", get(headers, "WARC-Target-URI")), ("WARC-Date", get(headers, "WARC-Date")), ("WARC-Refers-To", source)) if v or not broken and v is not None]
    linked = [(k, v) for k in ("WARC-Payload-Digest", "WARC-Warcinfo-ID") if (v := get(headers, k))]
    info: dict = {"source": {k: v for k, v in headers if k.lower() != "content-length"}, "source-headers": headers}
    text = None
    try:
        if broken:
            raise broken
        status, http, body = read_headers(block)
        info |= {"status": status, "http": dict(http), "http-headers": http}
        body = entity(http, body)
        page = decoded(body, get(http, "Content-Type"))
        title, links, text = read_page(page)
        text = text.encode()
        actual = sha1_digest(body)
        info |= {"title": title, "links": links, "payload-length": len(body), "payload-digest-matches": dict(linked).get("WARC-Payload-Digest", actual) == actual}
    except READ_ERRORS as e:
        text = None
        info["error"] = f"{type(e).__name__}: {e}"
    source = source or sha1_digest(record)
    concurrent = record_id(source, "conversion")
    meta = json.dumps(info, ensure_ascii=False, sort_keys=True).encode()
    links_to = [("WARC-Concurrent-To", concurrent)] if text is not None else []
    yield "metadata", [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(source, "metadata")), *shared, *[("WARC-Source-" + k.removeprefix("WARC-"), v) for k, v in linked], *links_to, ("WARC-Block-Digest", sha1_digest(meta)), ("Content-Type", "application/json")], meta
    if text is not None:
        yield "conversion", [("WARC-Type", "conversion"), ("WARC-Record-ID", concurrent), *shared, *[("WARC-Source-" + k.removeprefix("WARC-"), v) for k, v in linked], ("WARC-Block-Digest", sha1_digest(text)), ("WARC-Payload-Digest", sha1_digest(text)), ("Content-Type", "text/plain; charset=utf-8")], text


FIELDS = ["record_type", "record_id", "refers_to", "target_uri", "date", "source_digest", "block_digest"]


def build_derivatives(records: DataFrame, *, key: str, record: str = "record", with_records: bool = True) -> DataFrame:
    """records (key, WARC record bytes, gzip or plain) -> key, the linking headers, n_bytes of the block, n_links, and the record."""
    C.bounded_batches(records.sparkSession)
    source = records.select(records[key], records[record].cast("binary").alias("gl_r"))
    fields = [source.schema[0], *(T.StructField(n, T.StringType()) for n in FIELDS), T.StructField("n_bytes", T.LongType()), T.StructField("n_links", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("derived", T.BinaryType())] if with_records else []))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, raw in enumerate(b.column(1)):
                for kind, headers, block in derivatives(raw.as_py() or b""):
                    at.append(i)
                    links = len(json.loads(block).get("links", ())) if kind == "metadata" else None
                    row = [kind, *(get(headers, h) for h in ("WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Source-Payload-Digest", "WARC-Block-Digest")), len(block), links]
                    rows.append(row + ([write_record(headers, block)] if with_records else []))
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.string()] * len(FIELDS) + [pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *made], names=names)

    return source.mapInArrow(run, schema)


def page_responses(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, record: each page as a response record."""
    C.bounded_batches(pages.sparkSession)
    source = pages.select(pages[page_id], F.coalesce(pages[url], F.lit("")).alias("u"), F.coalesce(pages[page], F.lit("")).alias("h"))
    schema = T.StructType([source.schema[0], T.StructField("record", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, bodies = b.column(0).cast(pa.string()).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()
            made = [response_record(i or "", u, body, date) for i, u, body in zip(ids, urls, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, number, record: the records of the .warc and .warc.gz files of a folder. A file is split in one task, which holds it whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, body in zip(b.column(0), b.column(1), strict=True):
                for i, record in enumerate(split_records(body.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([i], pa.int64()), pa.array([record], pa.binary())], names=["path", "number", "record"])

    C.bounded_batches(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    return found.select("path", "content").mapInArrow(run, "path string, number long, record binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a response record, and its metadata and conversion records."""
    return build_derivatives(page_responses(C.read(spark, sf_dir, "pages")), key="page_id")
