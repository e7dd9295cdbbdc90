"""Price lists: CSV with any of four delimiters, JSON, XLSX; headings are found by name."""

from __future__ import annotations

import csv
import io
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.functions import amounts, dates, text
from procura.operators.documents import delimiter_of, sheets

# Logical columns and their usual headings.
HEADINGS = {
    "product_name": "Bezeichnung", "manufacturer": "Hersteller", "model_number": "Typ", "article_number": "Artikelnummer", "amount": "Preis",
    "currency": "Waehrung", "basis": "Preisbasis", "vat_rate": "MwSt", "unit": "Einheit", "tiers": "Staffelpreise", "shipping_cost": "Versandkosten",
    "min_order_quantity": "Mindestmenge", "packaging_unit": "Verpackungseinheit", "availability": "Verfuegbarkeit", "lead_time_days": "Lieferzeit",
    "supplier": "Lieferant", "url": "Link", "price_date": "Preisstand",
}


def _file_rows(sheet: str | None, kind: str):
    """Rows of each file as a map from heading to text, with the file's path and the row's place."""

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if kind == "json":
                    found = json.loads(data)
                    rows = found if isinstance(found, list) else next(found[k] for k in ("products", "items", "rows", "articles") if k in found)
                    rows = [[(k, None if v is None else str(v)) for k, v in r.items()] for r in rows]
                elif kind == "csv":
                    lines = data.decode("utf-8-sig", "replace")
                    head, *table = csv.reader(io.StringIO(lines, newline=""), delimiter=delimiter_of(lines[:4096])) if lines.strip() else [[]]
                    rows = [list(dict(zip(head, (c or None for c in r))).items()) for r in table if any(r)]
                else:
                    head, *table = next(rows for name, rows in sheets(data) if sheet in (None, name))
                    rows = [list(dict(zip(head, (c or None for c in r))).items()) for r in table]
                kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
                cols = [[path] * len(rows), list(range(len(rows))), rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "no", "row"])

    return run


def load_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Rows of all files of ``path`` as text columns, headings in the order in which they first appear.

    A price list is one small file and is parsed whole, by one task; many of them are parsed apart.  CSV may have lines
    within quotes, and each file a delimiter of its own.  Only the headings come to the driver.
    """
    kind = path.lower().rsplit(".", 1)[-1]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_file_rows(sheet, kind if kind in ("csv", "json") else "xlsx"), "path string, no long, row map<string,string>")
    keys = rows.select("path", "no", F.posexplode(F.map_keys("row")).alias("at", "name"))
    names = [r.name for r in keys.groupBy("name").agg(F.min(F.struct("path", "no", "at")).alias("first")).orderBy("first").collect()]
    return rows.select(*[F.element_at("row", F.lit(n)).alias(n) for n in names])


def resolve(columns: list[str], wanted: dict[str, str] | None = None) -> dict[str, str]:
    """Logical name -> column of the file: the exact heading, else one that differs in case, blanks and dots only."""
    loose = lambda s: re.sub(r"[\s.]+", "", s).lower()
    by = {loose(c): c for c in reversed(columns)}
    want = HEADINGS | (wanted or {})
    return {k: h if h in columns else by[loose(h)] for k, h in want.items() if h in columns or loose(h) in by}


def quotes(rows: DataFrame, name: str, wanted: dict[str, str] | None = None, supplier: str | None = None, currency: str | None = None, basis: str | None = None, vat_rate: float | None = None) -> DataFrame:
    """Quotes with defaults of the list; rows without a product name are no quotes; doubts are warnings."""
    at = resolve(rows.columns, wanted)
    c = lambda k: text.blank_to_null(F.col(f"`{at[k]}`").cast("string")) if k in at else F.lit(None).cast("string")
    number = lambda k: amounts.amount(c(k))["value"]
    known = amounts.price_basis(c("basis"))
    the_basis = F.when(known == "UNKNOWN", F.lit(basis or "UNKNOWN")).otherwise(known)
    out = rows.where(c("product_name").isNotNull()).select(
        F.lit(name).alias("source"),
        c("product_name").alias("product_name"), c("manufacturer").alias("manufacturer"), c("model_number").alias("model_number"), c("article_number").alias("article_number"),
        number("amount").alias("amount"), F.coalesce(amounts.currency(c("currency")), F.lit(currency)).alias("currency"), the_basis.alias("basis"),
        F.coalesce(amounts.rate(c("vat_rate")), F.lit(vat_rate)).alias("vat_rate"), F.coalesce(text.normalize_unit(c("unit")), c("unit")).alias("unit"),
        amounts.tiers(c("tiers")).alias("tiers"), number("shipping_cost").alias("shipping_cost"), number("min_order_quantity").alias("min_order_quantity"),
        c("packaging_unit").alias("packaging_unit"), amounts.availability(c("availability")).alias("availability"), number("lead_time_days").cast("int").alias("lead_time_days"),
        F.coalesce(c("supplier"), F.lit(supplier), F.lit(name)).alias("supplier"), c("url").alias("url"), dates.parse_datetime(c("price_date")).alias("price_date"),
    )
    warn: list[Column] = [F.when(F.col("amount").isNull(), F.lit("price is missing")), F.when(F.col("basis") == "UNKNOWN", F.lit("price basis is missing"))]
    return out.withColumn("warnings", F.array_compact(F.array(*warn)))
