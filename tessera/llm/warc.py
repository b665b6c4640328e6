"""WARC derivatives: linked metadata and plain-text conversion records of response records.

`responses` makes WARC/1.1 response records of pages; `derive` parses any response records and adds, for each, a
metadata record (application/warc-fields: source digests, HTTP status and headers, title, declared language, link
count) and a conversion record (text/plain), both with WARC-Refers-To, WARC-Refers-To-Target-URI and -Date of their
source. Record ids are name-based UUIDs of the source id and kind, so that a task that runs again gives the same ids.
Digests are sha1 in base32. Records are gzip members in a binary column; `export` joins them to a .warc.gz file.

The page is decoded as its HTTP headers say: chunks put together, gzip or deflate undone, then the charset of the header,
of a meta tag or else UTF-8; what doesn't decode stays as it is, odd bytes become U+FFFD.

A null url or page counts as empty and still gives its records; a record of another type and data that is none give
nothing. A response that can't be read (bad gzip, no Content-Length or one beyond the data, no WARC-Record-ID) gives one
row of kind `malformed` without data. Repeated rows give equal records. An empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import markup, store

RECORDS = "source_key long, kind string, record_id string, refers_to string, data binary"
_CHARSET = re.compile(r"(?i)charset\s*+=\s*+[\"']?+([a-z0-9_.:-]+)")
_META = re.compile(rb"(?i)<meta\b[^<>]*?charset\s*+=\s*+[\"']?+([a-z0-9_.:-]+)")
_SPACE = uuid.UUID("8f9b1f5e-0d1a-5c57-9a5e-2d0b4b7c1e10")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; line breaks in values become spaces, so that a value can't add a header."""
    head = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one record; a ValueError where it isn't one or lacks a part."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit() or int(size) > len(rest) or not headers.get("warc-record-id"):
        raise ValueError("a record without its length or id")
    return headers, rest[: int(size)]


def unzipped(data: bytes | None) -> bytes:
    """The bytes of a record that may be a gzip member; a ValueError where it is a broken one."""
    if not data or data[:2] != b"\x1f\x8b":
        return data or b""
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError("a broken gzip member") from e


def _dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return data  # not chunks
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n


def decoded(fields: dict[str, str], payload: bytes) -> str:
    """The text of an HTTP payload by its header fields (lower-case names)."""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        payload = _dechunked(payload)
    for kind in reversed(fields.get("content-encoding", "").lower().split(",")):
        with contextlib.suppress(zlib.error):
            if kind.strip() in ("gzip", "x-gzip"):
                payload = zlib.decompress(payload, 47)
            elif kind.strip() == "deflate":
                payload = zlib.decompress(payload) if payload[:1] == b"\x78" else zlib.decompress(payload, -15)
    said = _CHARSET.search(fields.get("content-type", ""))
    meta = None if said else _META.search(payload)
    name = said[1] if said else meta[1].decode() if meta else "utf-8"
    try:
        return payload.decode(name, "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def _id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {source}')}>"


def response(key: int | None, url: str | None, page: str | None, date: str) -> bytes:
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    own = _id(f"{key} {url} {digest(payload)}", "response")
    return build([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def derivatives(record: bytes) -> list[tuple[str, str, bytes]]:
    """(kind, id, record) of the metadata and conversion records of a response record; none of any other record."""
    head, block = parse(record)
    if head.get("warc-type") != "response":
        return []
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.decode("latin-1").split("\r\n")
    page = decoded({k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, payload)
    source, uri, date = head["warc-record-id"], head.get("warc-target-uri", ""), head.get("warc-date", "")
    text = markup.plain(page).encode("utf-8", "replace")
    link = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    origin = [("source-payload-digest", head.get("warc-payload-digest", digest(payload))), ("source-block-digest", head.get("warc-block-digest", digest(block))), ("http-status", status), *(("http-header", x) for x in lines if x), ("title", markup.title(page)), ("language", markup.declared_language(page) or ""), ("links", str(markup.links(page))), ("conversion-record", _id(source, "conversion"))]
    fields = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in origin).encode("utf-8", "replace")
    out = []
    for kind, mime, body, extra in (("metadata", "application/warc-fields", fields, []), ("conversion", "text/plain; charset=utf-8", text, [("WARC-Source-Payload-Digest", origin[0][1])])):
        own = _id(source, kind)
        out.append((kind, own, build([("WARC-Type", kind), ("WARC-Record-ID", own), *link, *extra, ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(body)), ("Content-Type", mime)], body)))
    return out


def responses(pages: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """source_key, kind, record_id, refers_to (null) and data (a gzip member) of the response record of every page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = response(k, u, p, date)
                out.append((k, "response", parse(data)[0]["warc-record-id"], None, gzip.compress(data, 1, mtime=0)))
            yield _batch(out)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(rows, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], ["source_key", "kind", "record_id", "refers_to", "data"])


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records (source_key, data)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    raw = unzipped(data)
                    if raw.startswith(b"WARC/"):
                        source = parse(raw)[0]["warc-record-id"]
                        out.extend((k, kind, own, source, gzip.compress(made, 1, mtime=0)) for kind, own, made in derivatives(raw))
                except ValueError:
                    out.append((k, "malformed", None, None, None))
            yield _batch(out)

    return records.select(F.col("source_key").cast("long").alias("source_key"), F.col("data").cast("binary").alias("data")).mapInArrow(rows, RECORDS)


def summaries(records: DataFrame) -> DataFrame:
    """What the stored records say, parsed again: one row a record, with `intact`: its block has the stated digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    head, block = parse(unzipped(data))
                except ValueError:
                    out.append((k, kind, *[None] * 6, False))
                    continue
                source = head.get("warc-source-payload-digest")
                if kind == "metadata":
                    source = block.decode().partition("\r\n")[0].partition(": ")[2]
                if kind == "response":
                    source = head.get("warc-payload-digest")
                out.append((k, kind, head["warc-record-id"], head.get("warc-refers-to"), head.get("warc-target-uri"), source, head.get("warc-payload-digest"), len(block), digest(block) == head.get("warc-block-digest") and head.get("warc-type") == kind))
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            types = (pa.int64(), *[pa.string()] * 6, pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["source_key", "kind", "record_id", "refers_to", "uri", "source_digest", "payload_digest", "n_bytes", "intact"])

    return records.select("source_key", "kind", "data").mapInArrow(rows, "source_key long, kind string, record_id string, refers_to string, uri string, source_digest string, payload_digest string, n_bytes long, intact boolean")


def export(records: DataFrame, path: str) -> int:
    """Write records to one .warc.gz file on the driver, row after row; for tables of a file's size."""
    n = 0
    with open(path, "wb") as f:
        for r in records.select("data").toLocalIterator():
            f.write(r.data)
            n += 1
    return n


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = store.saved(responses(store.table(spark, sf_dir, "pages")), "warc-responses")
    made = store.saved(derive(source), "warc-derived")
    return summaries(made).withColumnRenamed("source_key", "page_id")
