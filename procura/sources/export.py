"""Exports: fixed columns, markers for what is missing, CSV, JSON and XLSX."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.functions.dates import days_until
from procura.functions.text import display
from procura.params import DEFAULTS


def export_frame(notices: DataFrame, as_of: Column) -> DataFrame:
    """The columns of an export of ``sources.notices`` rows, all text but for the counts."""
    shown = ["national_id", "title", "authority", "country", "region"]
    return notices.select(
        "id", "source", "source_id", *[display(F.col(c)).alias(c) for c in shown],
        display(F.col("cpv_codes"), "list").alias("cpv_codes"), display(F.col("publication_date")).alias("publication_date"),
        display(F.col("deadline"), "time").alias("deadline"), display(days_until(F.col("deadline"), as_of)).alias("days_until_deadline"),
        *[display(F.col(c)).alias(c) for c in ("estimated_value", "currency", "status", "procedure_type")],
        F.coalesce(F.size("documents"), F.lit(0)).alias("n_documents"), display(F.col("source_url")).alias("source_url"),
    )


def write_dataset(rows: DataFrame, path: str, kind: str) -> None:
    """A directory of part files, for results of any size."""
    if kind == "csv":
        rows.write.csv(path, sep=";", header=True, mode="overwrite")
    elif kind == "json":
        rows.write.json(path, mode="overwrite")
    else:
        raise ValueError(f"unknown format: {kind}")


def write_file(rows: DataFrame, path: str, kind: str, most: int = 100_000) -> int:
    """One file on the driver for people to open; more than ``most`` rows are refused, not cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows: write a dataset instead")
    table = [[("" if v is None else v) for v in r] for r in got]
    if kind == "csv":
        import csv

        with open(path, "w", encoding="utf-8-sig", newline="") as f:
            w = csv.writer(f, delimiter=";")
            w.writerow(rows.columns)
            w.writerows(table)
    elif kind == "json":
        body = {"count": len(got), "missing_value_marker": DEFAULTS.missing, "tenders": [r.asDict(True) for r in got]}
        Path(path).write_text(json.dumps(body, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    elif kind == "xlsx":
        _xlsx(path, [rows.columns, *table])
    else:
        raise ValueError(f"unknown format: {kind}")
    return len(got)


def _xlsx(path: str, table: list[list]) -> None:
    """A workbook of one sheet with inline texts, column widths and a frozen first row."""

    def cell(v: object) -> str:
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    widths = [min(60, max(8, *(len(str(r[i])) for r in table)) + 2) for i in range(len(table[0]))]
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    rows = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in table)
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Export" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}">{pane}<cols>{cols}</cols><sheetData>{rows}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
