"""Document bytes to text pages and tables, with a status and never an exception."""

from __future__ import annotations

import csv
import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.params import DEFAULTS

#: Name -> (media types, suffixes, function of bytes to (title, pages, tables)); the first that fits is taken.
EXTRACTORS: dict[str, tuple[tuple[str, ...], tuple[str, ...], Callable]] = {}

# Elements whose text is no document text, and elements without an end.
NOISE = {"script", "style", "noscript", "nav", "header", "footer"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())


def register_extractor(name: str, media_types: tuple[str, ...], suffixes: tuple[str, ...]):
    def keep(f: Callable) -> Callable:
        EXTRACTORS[name] = (media_types, suffixes, f)
        return f

    return keep


def _table(rows: list[list[str]], page: int, index: int, section: str | None = None) -> dict:
    """First row as header if there are more rows and all its cells are filled."""
    header = rows[0] if len(rows) > 1 and all(c.strip() for c in rows[0]) else None
    return {"page": page, "idx": index, "section": section, "header": header, "rows": rows[1:] if header else rows}


class _Page(HTMLParser):
    """Text without noise, and tables read before noise is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.text: list[str] = []
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.noise = 0
        self.in_title = False
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in NOISE:
            self.noise += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "table":
            self.open.append({"header": None, "rows": [], "row": None})
        elif tag == "tr" and self.open:
            self._end_row()
            self.open[-1]["row"] = []
        elif tag in ("td", "th") and self.open and self.open[-1]["row"] is not None:
            self._end_cell()
            self.cell = []
            self.open[-1]["row"].append((tag, self.cell))

    def handle_endtag(self, tag: str) -> None:
        if tag in NOISE:
            self.noise = max(0, self.noise - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table" and self.open:
            self._end_row()
            t = self.open.pop()
            if t["rows"] or t["header"]:
                self.tables.append({"page": 1, "idx": len(self.tables), "section": None, "header": t["header"], "rows": t["rows"]})

    def _end_cell(self) -> None:
        self.cell = None

    def _end_row(self) -> None:
        self._end_cell()
        if not self.open or not self.open[-1]["row"]:
            return
        t = self.open[-1]
        cells, t["row"] = t["row"], None
        values = [" ".join(parts) for _, parts in cells]
        if any(values):
            if t["header"] is None and all(tag == "th" for tag, _ in cells):
                t["header"] = values
            else:
                t["rows"].append(values)

    def handle_data(self, data: str) -> None:
        s = data.strip()
        if not s:
            return
        if self.in_title:
            self.title = self.title or s
        if self.cell is not None:
            self.cell.append(" ".join(s.split()))
        if not self.noise:
            self.text.append(s)


@register_extractor("html", ("text/html", "application/xhtml+xml"), (".html", ".htm"))
def _html(data: bytes, suffix: str) -> tuple:
    p = _Page()
    p.feed(data.decode("utf-8", "replace"))
    p.close()
    return p.title, ["\n".join(p.text)], p.tables


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = z.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document type declarations are not read")
    return ElementTree.fromstring(data)


@register_extractor(
    "docx", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword"), (".docx",)
)
def _docx(data: bytes, suffix: str) -> tuple:
    z = zipfile.ZipFile(io.BytesIO(data))
    body = _xml(z, "word/document.xml").find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    text = [s for p in body.findall(f"{_W}p") if (s := said(p))]
    tables = []
    for i, t in enumerate(body.findall(f"{_W}tbl")):
        rows = [[" ".join(filter(None, map(said, c.findall(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        rows = [r for r in rows if any(r)]
        if rows:
            tables.append(_table(rows, 1, i))
    title = None
    if "docProps/core.xml" in z.namelist():
        title = next((e.text for e in _xml(z, "docProps/core.xml") if e.tag.endswith("}title") and e.text), None)
    return title, ["\n".join(text)], tables


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Sheets of a workbook by name, rows of cell texts without empty rows."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(z, "xl/sharedStrings.xml").findall(f"{_S}si")]
    links = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    for s in _xml(z, "xl/workbook.xml").iter(f"{_S}sheet"):
        target = links[s.get(f"{_R}id")].lstrip("/")
        rows = []
        for r in _xml(z, target if target.startswith("xl/") else f"xl/{target}").iter(f"{_S}row"):
            row: list[str] = []
            for c in r.findall(f"{_S}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                v = c.find(f"{_S}v")
                kind = c.get("t")
                if kind == "s" and v is not None:
                    value = shared[int(v.text)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                else:
                    value = (v.text or "") if v is not None else ""
                row += [""] * (max(at, len(row) + 1) - 1 - len(row)) + [value.strip()]
            if any(row):
                rows.append(row)
        width = max(map(len, rows), default=0)
        yield s.get("name"), [r + [""] * (width - len(r)) for r in rows]


@register_extractor("xlsx", ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel"), (".xlsx", ".xlsm"))
def _xlsx(data: bytes, suffix: str) -> tuple:
    pages, tables = [], []
    for n, (name, rows) in enumerate(sheets(data), 1):
        pages.append("\n".join(" | ".join(filter(None, r)) for r in rows))
        if rows:
            tables.append(_table(rows, n, 0, name))
    return None, pages, tables


@register_extractor("text", ("text/plain", "text/csv", "application/csv"), (".txt", ".csv", ".md"))
def _text(data: bytes, suffix: str) -> tuple:
    text = data.decode("utf-8", "replace").lstrip("﻿")
    tables = []
    if suffix == ".csv":
        rows = [r for r in csv.reader(text.splitlines(), delimiter=delimiter_of(text)) if any(r)]
        if rows:
            tables.append(_table(rows, 1, 0))
    return None, [text.strip()], tables


def delimiter_of(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text[:4096], delimiters=";,\t|").delimiter
    except csv.Error:
        return ";"


def extractor_for(media_type: str | None, suffix: str) -> str | None:
    kind = (media_type or "").split(";")[0].strip().lower()
    return next((n for n, (types, suffixes, _) in EXTRACTORS.items() if kind in types or suffix.lower() in suffixes), None)


def extract(data: bytes | None, media_type: str | None, suffix: str, limit: int = DEFAULTS.max_text) -> dict:
    """Status FAILED, UNSUPPORTED, EMPTY (no text), PARTIAL (cut at ``limit`` characters) or OK, with what was read."""
    out = {"status": "OK", "error": None, "extractor": extractor_for(media_type, suffix), "title": None, "pages": [], "tables": []}
    out |= {"size": len(data) if data is not None else None, "checksum": hashlib.sha256(data).hexdigest() if data is not None else None}
    if data is None:
        return out | {"status": "FAILED", "error": "no content"}
    if out["extractor"] is None:
        return out | {"status": "UNSUPPORTED", "error": f"no reader for {media_type or suffix}"}
    try:
        out["title"], pages, out["tables"] = EXTRACTORS[out["extractor"]][2](data, suffix)
    except Exception as e:  # noqa: BLE001  a broken document does not stop a run
        return out | {"status": "FAILED", "error": f"{type(e).__name__}: {e}"[:500]}
    left = limit
    for n, text in enumerate(pages, 1):
        if left <= 0:
            out["status"] = "PARTIAL"
            break
        if len(text) > left:
            out["status"] = "PARTIAL"
        out["pages"].append({"number": n, "text": text[:left]})
        left -= len(text)
    if out["status"] == "OK" and not any(p["text"].strip() for p in out["pages"]):
        out["status"] = "EMPTY"
    return out


_TABLE = pa.struct(
    [("page", pa.int32()), ("idx", pa.int32()), ("section", pa.string()), ("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))]
)
_FIELDS = [
    ("status", pa.string()), ("error", pa.string()), ("extractor", pa.string()), ("title", pa.string()), ("size", pa.int64()), ("checksum", pa.string()),
    ("pages", pa.list_(pa.struct([("number", pa.int32()), ("text", pa.string())]))), ("tables", pa.list_(_TABLE)),
]
SCHEMA = (
    "status string, error string, extractor string, title string, size long, checksum string, pages array<struct<number:int,text:string>>, "
    "tables array<struct<page:int,idx:int,section:string,header:array<string>,rows:array<array<string>>>>"
)


def _extracted(batches):
    for b in batches:
        rows = [extract(c, m, s or "") for c, m, s in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
        cols = [pa.array([r[n] for r in rows], t) for n, t in _FIELDS]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc", *[n for n, _ in _FIELDS]])


def extract_documents(files: DataFrame) -> DataFrame:
    """``files(doc, content, media_type, suffix)`` to a row a file; bytes are read where they are, in Arrow batches."""
    kind = files.schema["doc"].dataType.simpleString()
    return files.select("doc", "content", "media_type", "suffix").mapInArrow(_extracted, f"doc {kind}, {SCHEMA}")


def html_documents(pages: DataFrame) -> DataFrame:
    """``pages(doc, html)`` to ``doc, title, text, n_tables, status``."""
    files = pages.select("doc", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"), F.lit("text/html").alias("media_type"), F.lit(".html").alias("suffix"))
    e = extract_documents(files)
    return e.select("doc", "title", F.get("pages", F.lit(0))["text"].alias("text"), F.size("tables").alias("n_tables"), "status")


def document_report(extracts: DataFrame) -> DataFrame:
    """One row: files, read ones (OK only), failed ones (failed or unsupported)."""
    s = F.col("status")
    return extracts.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(s == "OK").alias("n_extracted"), F.count_if(s.isin("FAILED", "UNSUPPORTED")).alias("n_failed"))


def table_rows(extracts: DataFrame) -> DataFrame:
    """``(doc, table_id, row_no, cells)`` and headers apart, as ``operators.items`` takes them."""
    t = extracts.select("doc", F.posexplode("tables").alias("no", "t")).withColumn("table_id", F.concat_ws("#", "doc", "no"))
    return t.select("doc", "table_id", F.posexplode("t.rows").alias("row_no", "cells"))


def table_headers(extracts: DataFrame) -> DataFrame:
    t = extracts.select("doc", F.posexplode("tables").alias("no", "t")).withColumn("table_id", F.concat_ws("#", "doc", "no"))
    return t.select("table_id", F.posexplode("t.header").alias("idx", "cell"))


def fetchable(documents: DataFrame, extracts: DataFrame, force: bool = False) -> DataFrame:
    """Public documents with a url that have no extract yet (all of them with ``force``)."""
    some = documents.where("access = 'PUBLIC' AND url IS NOT NULL")
    return some if force else some.join(extracts.select("doc"), "doc", "left_anti")
