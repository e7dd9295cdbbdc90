"""WARC derivatives: metadata and plain-text conversion records linked to their responses."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm.common import pieces, table

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"  # pages carry no date; a capture time is a column of responses in general
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:procura:warc")

_TOKEN = re.compile(r"<(?:(!--)|(/?)([A-Za-z][A-Za-z0-9]*)|[!?])")
_DROPPED = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template")}
_BREAKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav title head body html blockquote pre".split())
_CELLS = {"td", "th"}
_TITLE_END = re.compile(r"</title", re.I)
_HREF = re.compile(r"\bhref\s*=\s*[\"']", re.I)
_CHARSET = re.compile(r"charset=[\"']?([\w-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    """The same name for the same parts in every run."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; ``Content-Length`` is added.  Line ends inside a value would start another header and become blanks."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers in order and block of each record of concatenated ``data``: the inverse of ``serialize``.

    Raises ``ValueError`` where no whole record stands.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in head[1:])]
        size = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        at = end + 4 + int(size)
        yield headers, data[end + 4 : at]
        while data[at : at + 2] == b"\r\n":
            at += 2


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of ``data`` one after the other, each unpacked; data that are not gzip as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("gzip member is cut off")
            piece = view[at : at + (1 << 16)]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def plain_text(page: str) -> tuple[str, str, int]:
    """Text of a page, its title, and its number of links.

    A line for each block, without scripts, styles and comments; entities decoded.  One pass with a cursor: what is not
    closed runs to the end of the page, and a tag without an end is text.
    """
    page = re.sub(r"\s+", " ", page)
    out, title, links, at, seek = [], None, 0, 0, 0
    while m := _TOKEN.search(page, seek):
        comment, closing, name = m[1], m[2], (m[3] or "").lower()
        stop = page.find("-->" if comment else ">", m.end())
        if stop < 0 and not comment:
            break  # no tag has an end from here on
        out.append(page[at : m.start()])
        at = seek = len(page) if stop < 0 else stop + (3 if comment else 1)
        if name in _BREAKS:
            out.append("\n")
        elif name in _CELLS:
            out.append("\t")
        elif not name:
            out.append(" ")
        if closing or not name:
            continue
        if name == "a":
            links += bool(_HREF.search(page, m.end(), at))
        elif name in _DROPPED:
            end = _DROPPED[name].search(page, at)
            at = seek = end.end() if end else len(page)
            out.append(" ")
        elif name == "title" and title is None:
            end = _TITLE_END.search(page, at)
            title = page[at : end.start()] if end else ""
    out.append(page[at:])
    lines = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), " ".join(html.unescape(title or "").split()), links


def split_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers as they came and in their order, and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body


def derive(response_id: str, uri: str, date: str, block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, headers, body = split_response(block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = _CHARSET.search(kind)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text, title, links = plain_text(page) if "html" in kind or not kind else (page, "", 0)
    block_digest, payload_digest = digest(block), digest(body)
    fields = [
        ("source-status", status),
        ("source-content-type", kind),
        ("source-block-digest", block_digest),
        ("source-payload-digest", payload_digest),
        *((f"source-header-{k}", v) for k, v in headers),
        ("title", title),
        ("n-outlinks", str(links)),
    ]
    meta = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields).encode()
    out = []
    for rtype, ctype, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text.encode())):
        name = record_id(rtype, response_id, block_digest)
        head = [
            ("WARC-Type", rtype),
            ("WARC-Record-ID", name),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Refers-To", response_id),
            ("WARC-Block-Digest", digest(data)),
            ("Content-Type", ctype),
        ]
        out.append(
            {
                "record_type": rtype,
                "record_id": name,
                "refers_to": response_id,
                "target_uri": uri,
                "content_type": ctype,
                "content_length": len(data),
                "block_digest": digest(data),
                "source_block_digest": block_digest,
                "source_payload_digest": payload_digest,
                "source_headers": "\r\n".join(f"{k}: {v}" for k, v in headers),
                "block": data,
                "record": serialize(head, data),
            }
        )
    return out


FIELDS = [
    ("page_id", pa.int64()),
    *((n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "content_type")),
    ("content_length", pa.int64()),
    *((n, pa.string()) for n in ("block_digest", "source_block_digest", "source_payload_digest", "source_headers")),
    ("block", pa.binary()),
    ("record", pa.binary()),
]
SCHEMA = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in FIELDS)


def responses(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """``page_id, response_id, uri, date, block`` of ``pages(page_id, url, html)``: each page as it came over HTTP.

    ``date`` is the column of capture times, if there is one.  Null urls and pages are empty.  Ids name id, url and
    content: rows that differ in any of them are captures of their own, equal rows are one capture and share a record id.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n")
    )
    name = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.md5(body)))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("response_id"),
        F.coalesce("url", F.lit("")).alias("uri"),
        (F.lit(DATE) if date is None else F.coalesce(date.cast("string"), F.lit(DATE))).alias("date"),
        F.concat(F.encode(head, "UTF-8"), body).alias("block"),
    )


def _read(batches):
    names = ["path", "page_id", "response_id", "uri", "date", "block", "error"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.binary(), pa.string()]
    for b in pieces(batches, 1):
        path, content = b.column(0)[0].as_py(), b.column(1)[0].as_py()
        out, size = [], 0

        def flush(rows):
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

        try:
            for member in members(content):
                for headers, block in parse(member):
                    h = {k.lower(): v for k, v in reversed(headers)}
                    if h.get("warc-type") == "response":
                        out.append((path, None, h.get("warc-record-id", ""), h.get("warc-target-uri", "").strip("<>"), h.get("warc-date", DATE), block, None))
                        size += len(block)
                        if size > 1 << 24:
                            yield flush(out)
                            out, size = [], 0
        except (ValueError, zlib.error) as e:
            out.append((path, None, None, None, None, None, str(e)))
        yield flush(out)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, plain or of gzip members: ``path`` and the columns of ``responses()``.

    A file is one row of Spark's binary source, 2 GB at most, and is unpacked member by member.  A file that breaks off
    gives its records up to there and a row with ``error``; other records are passed over; an empty file gives none.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "path string, page_id long, response_id string, uri string, date string, block binary, error string"
    return files.mapInArrow(_read, schema)


def _derived(batches):
    for b in pieces(batches, 64):
        ids, names, uris, dates, blocks = (b.column(i).to_pylist() for i in range(5))
        out = [r | {"page_id": p} for p, *x in zip(ids, names, uris, dates, blocks) for r in derive(*x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in FIELDS], [n for n, _ in FIELDS])


def derivatives(found: DataFrame) -> DataFrame:
    """Two rows for each row of ``responses()``: its metadata and its conversion, each as a whole record too.

    ``record`` is a complete WARC record; records of any rows one after the other are a WARC file.  An empty body
    gives an empty conversion, an empty table an empty one; rows without a block (``error``) are left out, other columns
    ignored.  Rows are written and read again like any table, which is how they survive executors.
    """
    return found.select("page_id", "response_id", "uri", "date", "block").where("block IS NOT NULL").mapInArrow(_derived, SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derivatives(responses(table(spark, sf_dir, "pages")))
    text = F.when(F.col("record_type") == "conversion", F.decode("block", "UTF-8"))
    return rows.withColumn("text", text).withColumn("record_sha256", F.sha2("record", 256)).drop("block", "record")
