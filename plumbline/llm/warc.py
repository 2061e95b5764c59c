"""Operator 6: WARC derivatives.

Pages become WARC response records in gzip members, one a record.  The derivative builder reads those files and
writes, for each response, a metadata record (title, links and sizes in JSON) and a plain-text conversion record.
Both refer to the response by WARC-Refers-To and keep its target URI, date, source headers and payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import open_store, rows_frame, scratch, settle

SPACE = uuid.UUID("6f2f6a52-7a07-4d0c-9d3e-1c2b7a0f5e11")
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
# what is opened and never closed reaches to the end, so that nothing is read twice
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "nav", "header", "footer", "title", "head", "body", "html", "blockquote", "pre", "hr", "td", "th", "dd", "dt"}
_TITLE = re.compile(r"<title(?:\s[^<>]*)?>([^<]*)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACES = re.compile(r"[ \t\r\f\v]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(map(str, parts)))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members, read in pieces."""
    raw, chunk = b"", zlib.decompressobj(31)
    member = bytearray()
    while True:
        if not raw:
            raw = stream.read(1 << 16)  # what follows a member is copied, so pieces are small
            if not raw:
                break
        member += chunk.decompress(raw)
        raw = chunk.unused_data
        if chunk.eof:
            head, _, rest = bytes(member).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            member, chunk = bytearray(), zlib.decompressobj(31)
    if member:
        raise ValueError("a record is cut short")


def one_line(value: object) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", str(value))


def plain_text(page: str) -> str:
    """Text between tags; comments, scripts and styles go, block tags end a line, entities are resolved."""
    text = _TAG.sub(lambda m: "\n" if m[3] and m[3].lower() in _BLOCKS else " " if m[1] or not m[3] else "", page)
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def response(page_id: int | None, url: str | None, page: str | None) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a page's response record."""
    body = (page or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + body
    return [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, digest(body))), ("WARC-Date", DATE), *([] if url is None else [("WARC-Target-URI", one_line(url))]),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("X-Page-Id", "" if page_id is None else str(page_id)),
    ], block


def derive(fields: dict[str, str], block: bytes) -> tuple[tuple[list, bytes], tuple[list, bytes]]:
    """The metadata and the conversion record of a response record, both linked to it."""
    head, _, body = block.partition(b"\r\n\r\n")
    if digest(body) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
    page, source = body.decode("utf-8", "replace"), head.decode("latin-1").split("\r\n")
    text, title = plain_text(page).encode(), _TITLE.search(page)
    meta = {"title": _SPACES.sub(" ", html.unescape(title[1])).strip() if title else None, "links": [html.unescape(a or b or c) for a, b, c in _LINK.findall(page)], "status": source[0], "headers": source[1:], "html_bytes": len(body), "text_bytes": len(text)}
    meta_block, refers = json.dumps(meta, ensure_ascii=False).encode(), fields["WARC-Record-ID"]
    uri = [(k, fields[k]) for k in ("WARC-Target-URI",) if k in fields]
    shared = [("WARC-Date", fields["WARC-Date"]), *uri, ("WARC-Refers-To", refers), ("WARC-Source-Payload-Digest", fields["WARC-Payload-Digest"]), ("X-Page-Id", fields["X-Page-Id"])]
    kind = lambda name, mime, data: ([("WARC-Type", name), ("WARC-Record-ID", record_id(name, refers)), *shared, ("Content-Type", mime), ("WARC-Block-Digest", digest(data))], data)
    return kind("metadata", "application/json", meta_block), kind("conversion", "text/plain", text)


def write_responses(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A WARC file for each partition; returns the manifest (path, n).  Files of failed attempts are never listed."""

    def write(batches):
        name, stream, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for pdf in batches:
            for page_id, url, page in zip(pdf["k"], pdf["u"], pdf["h"]):
                if stream is None:
                    store, base = open_store(folder)
                    store.create_dir(base)
                    stream = store.open_output_stream(f"{base}/{name}", compression=None)
                stream.write(record(*response(None if page_id is None or page_id != page_id else int(page_id), url, page)))
                n += 1
        if stream:
            stream.close()
            yield rows_frame([(name, n)], ["path", "n"])

    rows = pages.select(F.col(id_col).cast("decimal(20,0)").alias("k"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    return settle(rows.mapInPandas(write, "path string, n long"), "responses")


def dealt(manifest: DataFrame, name: str) -> DataFrame:
    """A manifest's files evenly over the tasks, by ranges of their random names."""
    return manifest.repartitionByRange(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), name)


def write_derivatives(manifest: DataFrame, folder: str) -> DataFrame:
    """For each response file a metadata file and a conversion file; returns (metadata, conversion, n)."""

    def write(batches):
        for pdf in batches:
            for path in pdf["path"]:
                store, base = open_store(folder)
                names, n = [f"{uuid.uuid4().hex}.{kind}.warc.gz" for kind in ("wat", "wet")], 0
                with store.open_input_stream(f"{base}/{path}", compression=None) as source, store.open_output_stream(f"{base}/{names[0]}", compression=None) as meta, store.open_output_stream(f"{base}/{names[1]}", compression=None) as text:
                    for fields, block in records(source):
                        if fields["WARC-Type"] == "response":
                            a, b = derive(fields, block)
                            meta.write(record(*a))
                            text.write(record(*b))
                            n += 1
                yield rows_frame([(*names, n)], ["metadata", "conversion", "n"])

    return settle(dealt(manifest, "path").mapInPandas(write, "metadata string, conversion string, n long"), "derivatives")


def read_derivatives(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files: page_id, url, response_id, metadata_id, conversion_id, payload_digest, title, links, text_bytes,
    text_crc32.  The two files of a pair hold their records in the same order."""
    schema = "page_id long, url string, response_id string, metadata_id string, conversion_id string, payload_digest string, title string, links int, text_bytes long, text_crc32 long"
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches):
        for pdf in batches:
            for meta_path, text_path in zip(pdf["metadata"], pdf["conversion"]):
                store, base = open_store(folder)
                out = []
                with store.open_input_stream(f"{base}/{meta_path}", compression=None) as meta, store.open_input_stream(f"{base}/{text_path}", compression=None) as text:
                    for (a, x), (b, y) in zip(records(meta), records(text), strict=True):
                        if a["WARC-Refers-To"] != b["WARC-Refers-To"] or digest(x) != a["WARC-Block-Digest"] or digest(y) != b["WARC-Block-Digest"]:
                            raise ValueError(f"{a['WARC-Record-ID']} and {b['WARC-Record-ID']} don't belong together or are damaged")
                        facts = json.loads(x)
                        out.append((int(a["X-Page-Id"]) if a["X-Page-Id"] else None, a.get("WARC-Target-URI"), a["WARC-Refers-To"], a["WARC-Record-ID"], b["WARC-Record-ID"], b["WARC-Source-Payload-Digest"], facts["title"], len(facts["links"]), len(y), zlib.crc32(y)))
                yield rows_frame(out, columns, {"page_id": "Int64"})

    return dealt(manifest, "metadata").mapInPandas(read, schema)


def derivatives(pages: DataFrame) -> DataFrame:
    """Write responses, build their derivatives and read those back: a row per page.

    Null pages are empty bodies; a null URL has no header and stays null; a null page_id stays null; repeated rows repeat their
    records, identifiers included; very long pages are one record each; an empty table gives no row."""
    folder = scratch(pages.sparkSession, "warc")
    return read_derivatives(write_derivatives(write_responses(pages, folder), folder), folder)
