"""File ingest: a directory tree becomes documents, relations and audit events. A file that fails is an event, not an error."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zlib
from collections.abc import Iterator
from email.message import Message

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schema as S
from gleaner.functions import text as X
from gleaner.operators.validity import with_health

RAW = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("source_path", "doc_type", "raw_text", *S.HEADER_COLUMNS, "filename", "content_type")]
    + [T.StructField("parent_path", T.StringType()), T.StructField("parse_ok", T.BooleanType())]
    + [T.StructField("parse_error", T.StringType()), T.StructField("ocr", T.StringType())]
)
COLUMNS = RAW.fieldNames()


def payload_text(part: Message) -> str:
    raw = part.get_payload(decode=True) or b""
    charset = part.get_content_charset() or "utf-8"
    try:
        return raw.decode(charset, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


class MailLoader:
    """RFC 5322 mail: one document for the body (plain text before HTML), one for each named attachment."""

    def can_load(self, path: str) -> bool:
        return path.lower().endswith(".eml")

    def load(self, path: str, content: bytes) -> list[dict]:
        message = email.message_from_bytes(content, policy=email.policy.compat32)
        body = {"plain": None, "html": None}
        attached = []
        for part in message.walk():
            if part.is_multipart():
                continue
            name = part.get_filename()
            if name:
                attached.append((name, part))
            elif part.get_content_maintype() == "text" and body.get(part.get_content_subtype(), "") is None:
                body[part.get_content_subtype()] = payload_text(part)
        text = body["plain"] if body["plain"] is not None else body["html"] or ""
        headers = {c: str(email.header.make_header(email.header.decode_header(message[h]))) for c, h in S.HEADERS.items() if message[h] is not None}
        rows = [{"source_path": path, "doc_type": "email", "raw_text": text, **headers}]
        for name, part in attached:
            readable = part.get_content_maintype() == "text"
            rows.append({"source_path": f"{path}#att:{name}", "doc_type": None, "raw_text": payload_text(part) if readable else "", "filename": name, "content_type": part.get_content_type(), "parent_path": path})
        return rows


class OutlookLoader:
    """.msg files through an optional parser."""

    def can_load(self, path: str) -> bool:
        return path.lower().endswith(".msg")

    def load(self, path: str, content: bytes) -> list[dict]:
        try:
            import extract_msg
        except ImportError as e:
            raise RuntimeError("reading .msg files needs the optional package extract_msg") from e
        m = extract_msg.Message(io.BytesIO(content))
        header = getattr(m, "header", None) or {}
        row = {"source_path": path, "doc_type": "email", "raw_text": m.body or "", "subject": m.subject, "from_": m.sender, "to_": m.to, "date": str(m.date)}
        row |= {"message_id": getattr(m, "messageId", None), "in_reply_to": getattr(m, "inReplyTo", None) or header.get("In-Reply-To"), "references": header.get("References"), "cc": getattr(m, "cc", None)}
        rows = [{k: v for k, v in row.items() if v is not None}]
        for a in getattr(m, "attachments", ()):
            name = getattr(a, "longFilename", None) or getattr(a, "shortFilename", None)
            if name:
                kind, data = getattr(a, "mimetype", None) or "", getattr(a, "data", b"")
                text = data.decode("utf-8", "replace") if kind.startswith("text/") and isinstance(data, bytes) else ""
                rows.append({"source_path": f"{path}#att:{name}", "doc_type": None, "raw_text": text, "filename": name, "content_type": kind, "parent_path": path})
        return rows


PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
PDF_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|\b(?:Td|TD|Tj|TJ|ET|BT)\b|['\"]")
PDF_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def plain_pdf_text(content: bytes) -> str:
    """The text layer of simple PDF files: literal and hexadecimal strings of the text operators, one line for each text move."""
    if not content.lstrip().startswith(b"%PDF-"):
        raise ValueError("no PDF header")
    pages = []
    for m in PDF_STREAM.finditer(content):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body:
            continue
        out: list[bytes] = []
        for token in PDF_SHOW.findall(body):
            if token[:1] == b"(":
                out.append(re.sub(rb"\\(.)", lambda x: PDF_ESCAPE.get(x[1], x[1]), token[1:-1], flags=re.S))
            elif token[:1] == b"<":
                out.append(bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode()))
            elif token in (b"T*", b"Td", b"TD", b"ET") and out and out[-1] != b"\n":
                out.append(b"\n")
        pages.append(b"".join(out).decode("latin-1").strip())
    return "\n".join(p for p in pages if p)


class PdfLoader:
    """PDF text layers: no text makes it a scan; a file that cannot be read is kept as corrupt."""

    def can_load(self, path: str) -> bool:
        return path.lower().endswith(".pdf")

    def load(self, path: str, content: bytes) -> list[dict]:
        row = {"source_path": path, "filename": path.rsplit("/", 1)[-1], "raw_text": "", "doc_type": "pdf_digital", "parse_ok": True}
        try:
            row["raw_text"] = self._text(content)
        except Exception as e:  # noqa: BLE001 - any parser error marks the file as corrupt
            return [row | {"parse_ok": False, "parse_error": f"{type(e).__name__}: {e}"[:200]}]
        if not row["raw_text"].strip():
            row |= {"doc_type": "pdf_scanned", "ocr": "out-of-scope"}
        return [row]

    @staticmethod
    def _text(content: bytes) -> str:
        try:
            from pypdf import PdfReader
        except ImportError:
            return plain_pdf_text(content)
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


class TextLoader:
    """.txt and .md files as they are."""

    def can_load(self, path: str) -> bool:
        return path.lower().endswith((".txt", ".md"))

    def load(self, path: str, content: bytes) -> list[dict]:
        return [{"source_path": path, "doc_type": "other", "raw_text": content.decode("utf-8", "replace"), "filename": path.rsplit("/", 1)[-1]}]


LOADERS = (MailLoader(), OutlookLoader(), PdfLoader())


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (without the scheme), content of every file below the folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.regexp_replace("path", "^file:/*(?=/)", "").alias("path"), "content")


def load(files: DataFrame, loaders=LOADERS) -> DataFrame:
    """One row for each document that a file holds, or one with a status of unsupported or load-failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                loader = next((x for x in loaders if x.can_load(path)), None)
                if loader is None:
                    rows.append({"path": path, "status": "unsupported"})
                    continue
                try:
                    rows += [{"path": path, "status": "loaded", **r} for r in loader.load(path, content)]
                except Exception as e:  # noqa: BLE001 - the run goes on, the event names the error
                    rows.append({"path": path, "status": "load-failed", "error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame(rows, columns=COLUMNS).astype(object).where(lambda x: x.notna(), None)

    return files.mapInPandas(run, RAW)


def to_documents(raw: DataFrame) -> DataFrame:
    """Canonical documents with id, normalised text and health columns; attachments name their mail."""
    ok = raw.filter("status = 'loaded'").withColumn("text", X.normalize_text(F.coalesce("raw_text", F.lit(""))))
    basis = F.when((F.col("text") == "") & F.col("parent_path").isNotNull(), F.col("filename")).otherwise(F.col("text"))
    docs = ok.withColumns(
        {
            "id": X.content_id(basis, F.col("source_path")),
            "doc_type": F.coalesce("doc_type", X.doc_type_of(F.coalesce("filename", F.lit("")))),
        }
    )
    mails = docs.filter("parent_path is null").select(F.col("path").alias("parent_path"), F.col("id").alias("attachment_of")).dropDuplicates(["parent_path"])
    return S.conform(with_health(docs.join(mails, "parent_path", "left")))


def attachment_relations(docs: DataFrame) -> DataFrame:
    rows = docs.filter("attachment_of is not null")
    return rows.select(F.col("id").alias("source"), F.lit(S.ATTACHMENT_OF).alias("kind"), F.col("attachment_of").alias("target"), F.coalesce("filename", F.lit("")).alias("evidence"))


def from_table(rows: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Canonical documents from a table of texts: the path is the source and the padded key."""
    path = F.concat_ws("/", F.coalesce(F.col(source), F.lit("")), F.lpad(F.col(key).cast("string"), 12, "0"))
    named = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text"), path.alias("source_path"), F.lit("other").alias("doc_type"))
    return S.conform(with_health(named.withColumn("id", X.content_id(F.col("text"), F.col("source_path")))))
