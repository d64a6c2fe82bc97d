"""WARC derivatives: response records to linked metadata and plain-text conversion records.

``response`` writes a WARC/1.1 response record; ``parse_record`` reads any record; ``derive`` turns a
response into a conversion record (the page's text as text/plain) and a metadata record. Both refer to the
response by WARC-Refers-To and to each other by WARC-Concurrent-To; both keep its target, date and payload
digest; the metadata's fields hold the HTTP status and headers and whether the digests were right.
Identifiers are derived from the response's, so reruns agree.

A payload is unwrapped first: chunks are joined, gzip and deflate are undone. HTML gives its text, other text types
their own; a payload of another type, or in an encoding that cannot be undone, has no conversion record, and its
metadata says so. A charset that is unknown, or is none of text, counts as UTF-8.

Defined results: null html is an empty payload and a null url an empty target; a record that is null or not a
whole response gives no derivatives, and nulls in place of what would be read from it; payloads of any length are
kept whole; repeated and tied rows give equal records; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, map_batches, texts
from .html_text import read_page

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"


class Record(NamedTuple):
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str:
        return next((v for k, v in self.headers if k.lower() == name.lower()), "")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_line(value: str) -> str:
    return " ".join(value.split())


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {one_line(v)}" for k, v in headers), f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record | None:
    """Headers (folded lines joined) and block; None if it is not one whole record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return None
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
        else:
            name, colon, value = line.partition(":")
            if not colon:
                return None
            headers.append((name.strip(), value.strip()))
    size = Record(headers, b"").get("Content-Length")
    if not size.isdecimal() or len(rest) < int(size):
        return None
    return Record(headers, rest[: int(size)])


def urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def response(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    payload = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", urn("response", page_id, url, digest(payload))), ("WARC-Target-URI", url or ""), ("WARC-Date", date),
        ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return write_record(headers, http + payload)


def split_http(block: bytes) -> tuple[int, list[tuple[str, str]], bytes]:
    """Status (0 if there is none), headers and payload of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    words = lines[0].split()
    status = int(words[1]) if len(words) > 1 and words[0].startswith("HTTP/") and words[1].isdecimal() else 0
    return status, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:])], payload


def header(headers: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in headers if k.lower() == name), "").strip().lower()


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    """The payload's characters by its declared charset."""
    name = header(headers, "content-type").partition("charset=")[2].split(";")[0].strip(" \"'")
    try:
        if name and codecs.lookup(name)._is_text_encoding:
            return payload.decode(name, "replace")
    except (LookupError, ValueError):  # no such charset, or one that does not decode
        pass
    return payload.decode("utf-8", "replace")


def dechunked(payload: bytes) -> bytes | None:
    """The body of a chunked message; None if it is none."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = payload[at:end].partition(b";")[0].strip()
        if end < 0 or not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + n])
        if len(out[-1]) < n:
            return None
        at = end + 2 + n + 2


def unwrapped(payload: bytes, headers: list[tuple[str, str]]) -> bytes | None:
    """The payload without its transfer and content encodings; None if one of them cannot be undone."""
    if "chunked" in header(headers, "transfer-encoding"):
        # crawlers often store the body already joined and keep the header
        joined = dechunked(payload)
        payload = payload if joined is None else joined
    for coding in reversed([c.strip() for c in header(headers, "content-encoding").split(",")]):
        if coding in ("", "identity"):
            continue
        if coding not in ("gzip", "x-gzip", "deflate"):
            return None
        for bits in (47, -15):  # with a header, or a bare deflate stream
            try:
                payload = zlib.decompress(payload, bits)
                break
            except zlib.error:
                continue
        else:
            return None
    return payload


def text_of(payload: bytes, headers: list[tuple[str, str]]) -> str | None:
    """The text of a payload, None if it has none."""
    kind = header(headers, "content-type").split(";")[0].strip()
    body = unwrapped(payload, headers)
    if body is None or not (kind in ("", "application/xhtml+xml") or kind.startswith("text/")):
        return None
    text = decoded(body, headers)
    return plain_text(text) if kind in ("", "text/html", "application/xhtml+xml") else text


def plain_text(html: str) -> str:
    """The page's text outside menus, scripts and the like, a line for each block."""
    return "\n".join(t for _, t in read_page(html))


def derive(raw: bytes) -> list[tuple[str, bytes]]:
    """(type, record) of the conversion and the metadata record of a response; nothing for other records."""
    source = parse_record(raw)
    if source is None or source.get("WARC-Type").lower() != "response" or not source.get("WARC-Record-ID"):
        return []
    status, http, payload = split_http(source.block)
    own, target, date = source.get("WARC-Record-ID"), source.get("WARC-Target-URI"), source.get("WARC-Date")
    payload_digest = source.get("WARC-Payload-Digest") or digest(payload)
    ids = {kind: urn(kind, own) for kind in ("conversion", "metadata")}
    found = text_of(payload, http)
    text = (found or "").encode()
    linked = lambda kind, other: [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", own), *([("WARC-Concurrent-To", ids[other])] if found is not None else []), ("WARC-Target-URI", target), ("WARC-Date", date)]
    conversion = write_record([*linked("conversion", "metadata"), ("WARC-Payload-Digest", digest(text)), ("Content-Type", "text/plain; charset=utf-8")], text)
    fields = [
        ("source-record-id", own), ("source-payload-digest", payload_digest), ("source-block-digest", source.get("WARC-Block-Digest")),
        ("payload-digest-valid", str(digest(payload) == payload_digest).lower()), ("block-digest-valid", str(source.get("WARC-Block-Digest") in ("", digest(source.block))).lower()),
        ("source-length", str(len(payload))), ("text-extracted", str(found is not None).lower()), ("text-length", str(len(text))), ("http-status", str(status)), *((f"http-header-{k.lower()}", v) for k, v in http),
    ]
    body = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode()
    metadata = write_record([*linked("metadata", "conversion"), ("Content-Type", "application/warc-fields")], body)
    return [*([("conversion", conversion)] if found is not None else []), ("metadata", metadata)]


def responses(pages: DataFrame) -> DataFrame:
    """page_id and ``warc``, the response record of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, urls, html = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
        return pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), pa.array(list(map(response, ids, urls, html)), pa.binary())], ["page_id", "warc"])

    return map_batches(pages.select("page_id", "url", "html"), "page_id long, warc binary", run)


def derivatives(records: DataFrame) -> DataFrame:
    """page_id, type and ``warc`` of the records derived from the responses in column ``warc``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, kind, made) for i, raw in zip(batch.column("page_id").to_pylist(), batch.column("warc").to_pylist(), strict=True) if raw for kind, made in derive(raw)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "type", "warc"])

    bounded_batches(records.sparkSession)
    return records.select("page_id", "warc").mapInArrow(run, "page_id long, type string, warc binary")


def record_digests(derived: DataFrame) -> DataFrame:
    """The headers of the records and the digest of their blocks, read back from their bytes."""
    names = {"record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest"}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [parse_record(r) if r else None for r in batch.column("warc").to_pylist()]
        each = lambda f, kind: pa.array([None if r is None else f(r) for r in found], kind)
        columns = [batch.column("page_id"), batch.column("type"), *(each(lambda r, h=h: r.get(h), pa.string()) for h in names.values())]
        columns += [each(lambda r: len(r.block), pa.int64()), each(lambda r: r.block.decode("utf-8", "replace"), pa.string()), each(lambda r: digest(r.block) == r.get("WARC-Block-Digest"), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "type", *names, "content_length", "block", "digest_valid"])

    return map_batches(derived, "page_id long, type string, " + ", ".join(f"{n} string" for n in names) + ", content_length long, block string, digest_valid boolean", run)
