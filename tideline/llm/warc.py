"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives two records that refer to it: a conversion, whose block is the
page's text, and a metadata record with the facts of the fetch and the conversion.
Both keep the response's record id (WARC-Refers-To), target URI and date; their payload
digest is computed.  The metadata block holds every HTTP header of the response, a
field each, and the payload digest that came with it.  Record ids are made from the
contents, so a rerun writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import markup
from tideline.llm.common import documents_columns, output_schema

VERSION = "WARC/1.1"
# Date of responses made from pages, which come without one.
PAGE_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
# Before the name of a response's HTTP header, as a field of the metadata block.
SOURCE_HEADER = "source-header-"
GIVEN_DIGEST = "payload-digest-given"
_CHARSET = re.compile(r"charset=[\"']?([\w\-]+)", re.I)

_EMPTY_LINE = re.compile(r"\r?\n\r?\n")
# The empty lines after a block and the next version line; the length of a block.
_BETWEEN = f"\r\n\r\n{VERSION}\r\n".encode()
_LENGTH = re.compile(rb"(?mi)^content-length:[ \t]*(\d+)")

_FIELDS = ("record_id", "warc_type", "refers_to", "target_uri", "date", "content_type", "content_length",
           "block_digest", "payload_digest", "source_headers", "block", "record")
SCHEMA = ", ".join(f"{name} {'long' if name == 'content_length' else 'string'}" for name in _FIELDS)


def sha1_digest(data: bytes) -> str:
    """Labelled SHA-1 in base 32, as WARC digests are written."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(parts))}>"


def one_line(value: str) -> str:
    """A header value: line breaks would end it."""
    return re.sub(r"[\r\n]+", " ", value)


def spell(headers: list[tuple[str, str]], block: bytes) -> str:
    """A record as text: version line, headers, empty line, block."""
    lines = "".join(f"{name}: {one_line(value)}\r\n" for name, value in headers if value)
    return f"{VERSION}\r\n{lines}\r\n" + block.decode("utf-8", "replace")


def http_parts(response: str) -> tuple[str, list[tuple[str, str]], str]:
    """Status line, headers and body of an HTTP response; without a head it is all body."""
    if not response.startswith("HTTP/"):
        return "", [], response
    # The head ends at its first empty line, however its lines end.
    end = _EMPTY_LINE.search(response)
    head, body = (response[:end.start()], response[end.end():]) if end else (response, "")
    # A line that begins with white space goes on with the value before it.
    status, *lines = re.split(r"\r\n|\r|\n", re.sub(r"(?:\r\n|\r|\n)[ \t]+", " ", head))
    pairs = [line.partition(":") for line in lines if ":" in line]
    return status, [(k.strip(" \t"), v.strip(" \t")) for k, _, v in pairs], body


def derive(record: dict) -> list[dict]:
    """The conversion and the metadata record of one response."""
    response = record["block"] or ""
    status, headers, body = http_parts(response)
    uri, date, source = (record[k] or "" for k in ("target_uri", "date", "record_id"))
    payload = sha1_digest(body.encode())
    given = record.get("payload_digest") or ""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    text = markup.plain_text(body) if not kind or "html" in kind.lower() else body if kind.lower().startswith("text/") else ""
    charset = _CHARSET.search(kind) or _CHARSET.search(body[:2000])
    facts = [
        ("fetch-status", status), ("source-content-type", kind),
        ("charset-detected", charset.group(1).lower() if charset else ""),
        ("payload-length", str(len(body.encode()))), ("text-length", str(len(text))),
        (GIVEN_DIGEST, given), ("payload-digest-agrees", str(given == payload).lower() if given else ""),
    ]
    out = []
    conversion = record_id("conversion", source, uri, payload)
    fields = [f"{k}: {one_line(v)}\r\n" for k, v in [*facts, ("conversion-record", conversion)] if v]
    lines = [f"{k}: {v}\r\n" for k, v in headers]
    kept = "".join(lines)
    blocks = [
        ("conversion", conversion, "text/plain; charset=utf-8", text.encode()),
        ("metadata", record_id("metadata", source, uri, payload, status, given, kept), "application/warc-fields",
         "".join([*fields, *(SOURCE_HEADER + line for line in lines)]).encode()),
    ]
    for warc_type, own, content_type, block in blocks:
        digest = sha1_digest(block)
        named = [
            ("WARC-Type", warc_type), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Refers-To", source), ("WARC-Concurrent-To", conversion if warc_type == "metadata" else ""),
            ("WARC-Block-Digest", digest), ("WARC-Payload-Digest", payload),
            ("Content-Type", content_type), ("Content-Length", str(len(block))),
        ]
        out.append({
            "record_id": own, "warc_type": warc_type, "refers_to": source, "target_uri": uri, "date": date,
            "content_type": content_type, "content_length": len(block), "block_digest": digest,
            "payload_digest": payload, "source_headers": kept, "block": block.decode(), "record": spell(named, block),
        })
    return out


def _derived(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(k) for k in keys),
                                *(pa.field(n, pa.int64() if n == "content_length" else pa.string()) for n in _FIELDS)])
            given = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out: list[list] = [[] for _ in schema.names]
            for i in range(len(batch)):
                for record in derive({n: values[i] for n, values in given.items()}):
                    for column, name in zip(out, schema.names, strict=True):
                        column.append(given[name][i] if name in keys else record[name])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def derivatives(responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Two records, conversion and metadata, per response record.

    ``responses`` has record_id, target_uri, date, payload_digest and block (the HTTP
    response as text), and ``keys`` that are carried along.  Null fields count as
    empty and their header is left out; an empty block gives an empty text.
    Repeated responses give repeated records with equal ids.  ``record`` is the
    record as it stands in a file.
    """
    keys = keys or []
    rows = documents_columns(responses, [*keys, "record_id", "target_uri", "date", "payload_digest", "block"])
    return rows.mapInArrow(_derived(keys), output_schema(rows, keys, SCHEMA))


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records of fetched pages (page_id, url, html): null html is an empty body."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    name = F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), "url", body).cast("binary"))
    part = lambda start, size: F.substring(name, start, size)
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))
    return pages.select(
        "page_id", urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit(PAGE_DATE).alias("date"),
        F.lit(None).cast("string").alias("payload_digest"), F.concat(head, body).alias("block"))


def write(records: DataFrame, path: str, column: str | Column = "record") -> None:
    """The records as gzip-compressed WARC files below ``path``, a file per partition."""
    records.select(F.col(column) if isinstance(column, str) else column).write.option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a file in order, joined again where a block held what looks like the next record.

    A record is whole when its block has Content-Length bytes; one is held at a time.
    """
    parts: list[bytes] = []
    missing = 0
    for batch in batches:
        out: list[bytes] = []
        for value in batch.column("value").to_pylist():
            if parts:
                parts.append(value)
                missing -= len(_BETWEEN) + len(value)
            else:
                head, _, block = value.partition(b"\r\n\r\n")
                length = _LENGTH.search(head)
                parts, missing = [value], (int(length.group(1)) if length else 0) - len(block)
            if missing <= 0:
                out.append(_BETWEEN.join(parts))
                parts = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([_BETWEEN.join(parts)], pa.binary())], names=["value"])


def read(spark, path: str) -> DataFrame:
    """Records of compressed WARC files: warc_type, record_id, refers_to, target_uri, date, digests and block.

    Of a metadata record also source_headers, the response's HTTP headers a line each,
    and given_digest, the payload digest that came with the response; both are null
    for other records, which refer to the same response.
    """
    # The empty lines after a block belong to the separator: a header may end with the version.
    # A compressed file is one partition and its pieces come in order.
    pieces = spark.read.option("lineSep", _BETWEEN.decode()).text(path).where(F.length("value") > 0)
    lines = pieces.select(F.col("value").cast("binary")).mapInArrow(_whole_records, "value binary").select(F.col("value").cast("string"))
    head = F.substring_index("value", "\r\n\r\n", 1)

    def header(name: str) -> Column:
        found = F.regexp_extract(head, rf"(?mi)^{name}:[ \t]*([^\r\n]*)", 1)
        return F.when(found != "", found)

    length = header("Content-Length").cast("long")
    body = F.substring(F.col("value").cast("binary"), F.octet_length(head) + 5, length.cast("int")).cast("string")
    # Only line breaks that the writer sets end a field.
    fields = F.split(body, "\r\n")

    def named(prefix: str) -> Column:
        return F.transform(F.filter(fields, lambda f: f.startswith(prefix)), lambda f: F.substring(f, len(prefix) + 1, F.length(f)))

    is_metadata = F.lower(header("WARC-Type")) == "metadata"
    source_headers = F.array_join(F.transform(named(SOURCE_HEADER), lambda f: F.concat(f, F.lit("\r\n"))), "")
    return lines.select(
        header("WARC-Type").alias("warc_type"), header("WARC-Record-ID").alias("record_id"),
        header("WARC-Refers-To").alias("refers_to"), header("WARC-Target-URI").alias("target_uri"),
        header("WARC-Date").alias("date"), header("Content-Type").alias("content_type"), length.alias("content_length"),
        header("WARC-Block-Digest").alias("block_digest"), header("WARC-Payload-Digest").alias("payload_digest"),
        body.alias("block"), F.when(is_metadata, source_headers).alias("source_headers"),
        F.when(is_metadata, F.try_element_at(named(f"{GIVEN_DIGEST}: "), F.lit(1))).alias("given_digest"))


def digest(records: DataFrame) -> DataFrame:
    """Everything of a record but its bytes, for which a SHA-256 stands."""
    return records.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "payload_digest",
        F.length("source_headers").cast("long").alias("source_header_chars"),
        F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256"))
