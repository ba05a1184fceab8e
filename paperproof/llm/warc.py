"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is a row (warc_type, headers, block): headers is a map of the named fields, block the bytes after them. Both
derivatives refer to their response's WARC-Record-ID, keep its target URI, date and HTTP headers, and carry the digests
of the source beside their own. Record ids are made from content, so a task that runs again makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperproof.llm.common import parts
from paperproof.llm.html import plain_text

RECORD = "warc_type string, headers map<string,string>, block binary"
VERSION = "WARC/1.1"  # fixed value
_SCHEMA = pa.schema([("warc_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def _id(*parts: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'|'.join(parts)).digest()[:16], version=5)}>"


def _rows(rows: list[tuple[str, dict, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([list(r[1].items()) for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r[2] for r in rows], pa.binary())], schema=_SCHEMA)


def responses(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record for each row of pages(page_id, url, html, ...), as a crawler would have kept it; pages have no
    date, so all get this one. A null html is an empty body, a null url an empty target. Equal rows give equal records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "html"):
            if len(b):
                rows = []
                for page_id, url, html in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist(), strict=True):
                    body = (html or "").encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                    rows.append(("response", {
                        "WARC-Record-ID": _id(b"response", str(page_id).encode(), (url or "").encode(), body), "WARC-Date": date, "WARC-Target-URI": url or "",
                        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block),
                    }, block))
                yield _rows(rows)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, RECORD)


def http_parts(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """(status line, headers in order, body) of an HTTP message; one without an empty line is all headers, if it begins as a message, or all body."""
    head, parted, body = block.partition(b"\r\n\r\n")
    if not parted and not block.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [[k.strip(), v.strip()] for k, _, v in (x.partition(":") for x in lines)], body


def decoded(body: bytes, headers: list[list[str]]) -> str:
    """The body as text by its Content-Type's charset; UTF-8 where that is none that can be read. Broken bytes read U+FFFD."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    try:
        return body.decode(kind.lower().partition("charset=")[2].split(";")[0].strip("\"' ") or "utf-8", "replace")
    except (LookupError, ValueError):  # no such charset, or one for host names and the like
        return body.decode("utf-8", "replace")


def derived(headers: dict[str, str], block: bytes) -> list[tuple[str, dict[str, str], bytes]]:
    """The conversion and the metadata record of one response."""
    source = headers.get("WARC-Record-ID") or _id(b"response", block)
    status, http, body = http_parts(block)
    payload, whole = digest(body), digest(block)
    text = plain_text(decoded(body, http)).encode("utf-8", "replace")
    same = {"WARC-Date": headers.get("WARC-Date") or "", "WARC-Target-URI": headers.get("WARC-Target-URI") or "", "WARC-Refers-To": source}
    made = "; ".join(f"{k}={v}" for k, v in (("source-payload", payload), ("source-block", whole)))
    conversion = {"WARC-Record-ID": _id(b"conversion", source.encode(), text), **same, "Content-Type": "text/plain; charset=utf-8", "WARC-Block-Digest": digest(text), "WARC-Source-Digests": made}
    claims = {k: headers.get(k) for k in ("WARC-Payload-Digest", "WARC-Block-Digest")}
    about = json.dumps({
        "refers-to": source, "conversion": conversion["WARC-Record-ID"], "warc-headers": dict(headers), "http-status": status, "http-headers": http,
        "payload-length": len(body), "payload-digest": payload, "payload-digest-agrees": claims["WARC-Payload-Digest"] in (None, payload),
        "block-digest": whole, "block-digest-agrees": claims["WARC-Block-Digest"] in (None, whole), "text-length": len(text), "text-digest": conversion["WARC-Block-Digest"],
    }, ensure_ascii=False, sort_keys=True).encode()
    metadata = {"WARC-Record-ID": _id(b"metadata", source.encode(), about), **same, "Content-Type": "application/json", "WARC-Block-Digest": digest(about), "WARC-Source-Digests": made, "WARC-Concurrent-To": conversion["WARC-Record-ID"]}
    return [("conversion", conversion, text), ("metadata", metadata, about)]


def derivatives(records: DataFrame) -> DataFrame:
    """Two records (conversion, metadata) for each response of records(warc_type, headers, block, ...); other types give none.

    Null headers or blocks are empty ones; a response without an id gets one from its block. Repeated responses give
    repeated, equal records. Digests that the source claims are compared with its bytes, and the metadata says the outcome.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "block"):
            yield _rows([r for h, x in zip(b["headers"].to_pylist(), b["block"].to_pylist(), strict=True) for r in derived(dict(h or ()), x or b"")])

    return records.where("warc_type = 'response'").select("headers", "block").mapInArrow(run, RECORD)


def serialized(warc_type: str, headers: dict[str, str], block: bytes) -> bytes:
    """A record without the two line ends that close it. Line breaks in a field are percent-coded, as a field is one line; null values are empty."""
    named = {"WARC-Type": warc_type, **headers, "Content-Length": str(len(block))}
    line = lambda x: (x or "").replace("\r", "%0D").replace("\n", "%0A")
    return f"{VERSION}\r\n".encode() + b"".join(f"{line(k)}: {line(v)}\r\n".encode() for k, v in named.items()) + b"\r\n" + block


def write_warc(records: DataFrame, path: str, *, compression: str = "gzip") -> None:
    """Write records of any bytes as WARC files, one per partition, by Spark's text writer, which passes bytes on as they are:
    what closes a record is the writer's line separator. Files appear once their task is done. Null headers or blocks are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "block"):
            yield pa.record_batch([pa.array([serialized(t or "", dict(h or ()), x or b"") for t, h, x in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.binary())], names=["value"])

    lines = records.select("warc_type", "headers", "block").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parsed(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """The records of a WARC file, by their lengths. A record that the file's end cuts off is left out, one whose length is missing or no number is empty."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        _, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        named = {k.lower(): k for k in headers}
        said = headers.pop(named.get("content-length", ""), "")
        n = int(said) if said.isascii() and said.isdigit() else 0
        if end + 4 + n > len(data):
            return
        yield headers.pop(named.get("warc-type", ""), ""), headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files in path (*.warc, *.warc.gz, and what write_warc names part-*), gzip or plain. A file is read by
    one task and must fit its memory, as WARC files do (about 1 GB by custom); records go on as they are parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for i in range(len(b)):
                data = b["content"][i].as_py()
                held, size = [], 0
                for record in parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    held.append(record)
                    size += len(record[2])
                    if size > 4 << 20 or len(held) >= 1000:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "{part-*,*.warc,*.warc.gz}").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def derivative_table(pages: DataFrame) -> DataFrame:
    """The derivatives of pages' responses as flat columns: warc_type, record_id, refers_to, target_uri, warc_date,
    content_type, block_digest, source_digests, content_length, text (the block). Two rows for each row of pages; a null html
    is an empty page, a null url an empty target, repeated rows give equal records, and further columns aren't read."""
    h = lambda k: F.element_at("headers", k)
    return derivatives(responses(pages)).select("warc_type", h("WARC-Record-ID").alias("record_id"), h("WARC-Refers-To").alias("refers_to"), h("WARC-Target-URI").alias("target_uri"), h("WARC-Date").alias("warc_date"), h("Content-Type").alias("content_type"), h("WARC-Block-Digest").alias("block_digest"), h("WARC-Source-Digests").alias("source_digests"), F.length("block").cast("long").alias("content_length"), F.decode("block", "UTF-8").alias("text"))
