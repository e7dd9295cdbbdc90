"""Line items: column roles, rows to items, text fallback, confidence, duplicates, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from procura.functions import constants as C
from procura.functions.amounts import amount
from procura.functions.text import blank_to_null, let, looks_like_unit, normalize_text, normalize_unit
from procura.params import DEFAULTS

_ALIASES = [(alias, role) for role, names in C.HEADINGS.items() for alias in names.split("|")]


def header_role(cell: Column) -> Column:
    """Role of a heading: its own name, else the longest name in it as a whole word (the first of equals); or null."""
    key = normalize_text(cell)
    exact = F.element_at(F.create_map(*[F.lit(x) for alias, role in dict(_ALIASES).items() for x in (alias, role)]), key)
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    names = F.array(*[F.struct(F.lit(-len(a)).alias("n"), F.lit(i).alias("i"), F.lit(f" {a} ").alias("a"), F.lit(r).alias("r")) for i, (a, r) in enumerate(_ALIASES)])
    inside = F.array_min(F.filter(names, lambda x: F.contains(padded, x["a"])))
    return F.coalesce(exact, inside["r"])


def map_columns(headers: DataFrame) -> DataFrame:
    """``headers(table_id, idx, cell)`` to ``(table_id, role, idx)``: the first column of a role has it."""
    return headers.withColumn("role", header_role(F.col("cell"))).where("role IS NOT NULL").groupBy("table_id", "role").agg(F.min("idx").alias("idx"))


def infer_columns(cells: DataFrame) -> DataFrame:
    """Roles from contents: ``cells(table_id, idx, cell)`` to ``(table_id, role, idx)``.

    From left to right a column of four fifths positions (one of the first two) or units (short) takes that role once;
    columns of numbers without currency, and of long texts, are candidates: the first of the numbers is the quantity,
    the longest text the description.
    """
    v = F.trim("cell")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    per = (
        cells.where("cell <> ''")
        .groupBy("table_id", "idx")
        .agg(
            share(v.rlike(C.POSITION)).alias("pos"),
            share(looks_like_unit(v)).alias("unit"),
            share(amount(v)["value"].isNotNull()).alias("num"),
            F.bool_or(v.rlike(C.CURRENCY_HINT)).alias("cur"),
            F.avg(F.length(v)).alias("len"),
        )
    )
    t = W.partitionBy("table_id")
    position = F.min(F.when((F.col("pos") >= 0.8) & (F.col("idx") <= 1), F.col("idx"))).over(t)
    per = per.withColumn("p", position)
    is_p = F.col("idx").eqNullSafe(F.col("p"))
    per = per.withColumn("u", F.min(F.when(~is_p & (F.col("unit") >= 0.8) & (F.col("len") <= 8), F.col("idx"))).over(t))
    free = ~is_p & ~F.col("idx").eqNullSafe(F.col("u"))
    number = free & (F.col("num") >= 0.8) & ~F.col("cur")
    text = free & ~number & (F.col("len") >= 10)
    agg = per.groupBy("table_id").agg(
        F.min("p").alias("POSITION"),
        F.min("u").alias("UNIT"),
        F.min(F.when(number, F.col("idx"))).alias("QUANTITY"),
        F.min(F.when(text, F.struct(-F.col("len"), "idx")))["idx"].alias("DESCRIPTION"),
    )
    return agg.unpivot("table_id", ["POSITION", "UNIT", "QUANTITY", "DESCRIPTION"], "role", "idx").where("idx IS NOT NULL")


def item_tables(roles: DataFrame) -> DataFrame:
    """Ids of tables with a description and one of quantity, unit or position."""
    has = lambda *r: F.bool_or(F.col("role").isin(*r))
    return roles.groupBy("table_id").agg(has("DESCRIPTION").alias("d"), has("QUANTITY", "UNIT", "POSITION").alias("q")).where("d AND q").select("table_id")


def quantity(raw: Column) -> Column:
    """``struct(value, estimated, warning)``: what is on demand, unreadable or negative is null with a warning."""
    def read(x: Column) -> Column:
        return let(amount(F.trim(F.regexp_replace(x, C.APPROXIMATE, " "))), lambda a: _judged(x, a))

    return let(blank_to_null(raw), read)


def _judged(x: Column, a: Column) -> Column:
    demand, rough, bad = x.rlike(C.ON_DEMAND), x.rlike(C.APPROXIMATE), a["value"].isNull()
    ok = ~demand & ~bad & (a["value"] >= 0)
    warning = (
        F.when(x.isNull(), F.lit(None))
        .when(demand, "quantity is not fixed")
        .when(bad, "quantity is unreadable")
        .when(a["value"] < 0, "negative quantity")
        .when(a["confidence"] < 100, "separator of the quantity is ambiguous")
    )
    estimated = F.coalesce(ok & (rough | (a["confidence"] < 100)), F.lit(False))
    return F.struct(F.when(ok, a["value"]).alias("value"), estimated.alias("estimated"), warning.alias("warning"))


def split_title(text: Column) -> Column:
    """``struct(title, description)``: the first line, cut at a word after 120 characters; the whole if it says more."""
    def parts(lines: Column) -> Column:
        full = F.trim(F.array_join(lines, " "))
        return let(_cut(F.trim(F.get(lines, F.lit(0)))), lambda t: F.struct(t.alias("title"), F.when(full != t, full).alias("description")))

    return let(F.split(F.trim(text), r"\s*\n\s*"), parts)


def _cut(first: Column) -> Column:
    head = F.substring(first, 1, 120)
    short = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(first) <= 120, first).otherwise(F.concat(short, F.lit("...")))


def clean_attribute(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, C.EQUIVALENCE, " "), r"(?U)\s+", " "), r"^[ .,;:-]+|[ .,;:-]+$", ""), F.lit(""))


def attributes(*texts: Column) -> Column:
    """``struct(manufacturer, model_number, article_number, specifications)``, each from the first text that has it."""
    one = lambda p, c: F.coalesce(*[c(F.nullif(F.regexp_extract(t, p, 1), F.lit(""))) for t in texts])
    keys = "|".join(C.SPEC_KEYS)
    pattern = rf"(?iU)\b({keys})\s*[:=]\s*([^,;\n|]{{1,40}})"
    every = F.flatten(
        F.array_compact(F.array(*[F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("v")) for t in texts]))
    )
    entries = F.transform(every, lambda e: F.struct(F.initcap(e["k"]).alias("k"), F.trim(e["v"]).alias("v")))

    def first_values(found: Column) -> Column:
        value = lambda k: F.get(F.filter(found, lambda e: e["k"] == k), F.lit(0))["v"]
        return let(F.array_distinct(F.transform(found, lambda e: e["k"])), lambda names: F.map_from_arrays(names, F.transform(names, value)))

    return F.struct(
        one(C.MANUFACTURER, clean_attribute).alias("manufacturer"),
        one(C.MODEL, clean_attribute).alias("model_number"),
        one(C.ARTICLE, F.trim).alias("article_number"),
        let(entries, first_values).alias("specifications"),
    )


def confidence(base: Column, q: Column, estimated: Column, unit: Column, unit_original: Column, position: Column, maker: Column, article: Column, n_specs: Column, title: Column) -> Column:
    """How completely a row was read, 0 to 95."""
    # Points.
    points = (
        base
        + F.when(q.isNull(), 0).when(estimated, 12).otherwise(20)
        + F.when(unit.isNotNull(), 10).when(unit_original.isNotNull(), 3).otherwise(0)
        + F.when(position.isNotNull(), 8).otherwise(0)
        + F.when(maker.isNotNull(), 8).otherwise(0)
        + F.when(article.isNotNull(), 5).otherwise(0)
        + F.when(n_specs > 0, 4).otherwise(0)
        + F.when(F.length(title) >= 12, 5).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(DEFAULTS.max_confidence), points))


_FIELDS = ["position", "title", "description", "quantity", "estimated", "unit", "unit_original", "manufacturer", "model_number", "article_number", "specifications", "brand_locked", "confidence", "evidence", "warnings"]


def _finish(rows: DataFrame, base: int, keep: list[str]) -> DataFrame:
    """Attributes out of title, description and evidence where columns have none; brand lock; confidence."""
    rows = rows.withColumn("a", attributes(F.col("title"), F.col("description"), F.col("evidence")))
    for c in ("manufacturer", "model_number", "article_number"):
        rows = rows.withColumn(c, F.coalesce(c, f"a.{c}"))
    maker = F.coalesce("manufacturer", "model_number")
    rows = rows.withColumn("specifications", F.col("a.specifications")).withColumn("brand_locked", maker.isNotNull() & ~F.col("evidence").rlike(C.EQUIVALENCE))
    score = confidence(
        F.lit(base), F.col("quantity"), F.col("estimated"), F.col("unit"), F.col("unit_original"), F.col("position"), maker, F.col("article_number"), F.size("specifications"), F.col("title")
    )
    return rows.withColumn("confidence", score).withColumn("evidence", F.substring("evidence", 1, 1000)).select(*keep, *_FIELDS)


def from_tables(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Items of table rows.

    ``rows(tender_id, doc, table_id, row_no, cells)``; ``roles`` as ``map_columns()`` or ``infer_columns()`` give them.
    Rows without a description of three characters, and sums, are no items.
    """
    idx = roles.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "idx"))).alias("roles"))
    r = rows.join(idx, "table_id").join(item_tables(roles), "table_id")
    cell = lambda role: blank_to_null(F.get("cells", F.element_at("roles", F.lit(role))))
    r = r.withColumn("text", cell("DESCRIPTION")).where((F.length("text") >= 3) & ~F.col("text").rlike(C.SUMMARY))
    r = r.withColumns({"t": split_title(F.col("text")), "q": quantity(cell("QUANTITY")), "unit_original": cell("UNIT"), "unit": normalize_unit(cell("UNIT"))})
    position = cell("POSITION")
    r = r.withColumns(
        {
            "title": F.col("t.title"),
            "description": F.col("t.description"),
            "quantity": F.col("q.value"),
            "estimated": F.col("q.estimated"),
            "position": F.when(position.rlike(C.POSITION), position),
            "manufacturer": cell("MANUFACTURER"),
            "model_number": cell("MODEL"),
            "article_number": cell("ARTICLE_NUMBER"),
            "evidence": F.array_join(F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != ""), " | "),
        }
    )
    unknown = F.when(F.col("unit_original").isNotNull() & F.col("unit").isNull(), F.lit("unit is unknown"))
    r = r.withColumn("warnings", F.array_compact(F.array(F.col("q.warning"), unknown)))
    return _finish(r, 40, ["tender_id", "doc", "table_id", "row_no"])


def from_text(pages: DataFrame) -> DataFrame:
    """Items of text lines with a position and a quantity in a known unit; ``pages(tender_id, doc, page, text)``."""
    lines = pages.select("tender_id", "doc", "page", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("row_no", "line"))
    rest = F.trim(F.regexp_extract("line", C.TEXT_POSITION, 2))
    r = lines.where(F.col("line").rlike(C.TEXT_POSITION)).withColumn("position", F.regexp_extract("line", C.TEXT_POSITION, 1)).withColumn("rest", rest)
    r = r.where(~F.col("rest").rlike(C.SUMMARY))
    whole = lambda g: F.regexp_extract_all("rest", F.lit(C.TEXT_QUANTITY), F.lit(g))
    found = F.filter(F.arrays_zip(whole(0).alias("whole"), whole(1).alias("q"), whole(2).alias("u")), lambda m: normalize_unit(m["u"]).isNotNull())
    r = r.withColumn("m", F.get(found, F.lit(0))).where("m IS NOT NULL")
    r = r.withColumn("qq", quantity(F.col("m.q"))).where("qq.value IS NOT NULL")
    at = F.instr(F.col("rest"), F.col("m.whole"))
    remainder = F.concat(F.substring(F.col("rest"), F.lit(1), at - 1), F.lit(" "), F.substring(F.col("rest"), at + F.length("m.whole"), F.length("rest")))
    remainder = F.regexp_replace(F.regexp_replace(remainder, r"\s+", " "), r"(?:\s*[,;]\s*){2,}", ", ")
    r = r.withColumn("text", F.regexp_replace(remainder, r"^[ \-:;,]+|[ \-:;,]+$", "")).where(F.length("text") >= 3)
    r = r.withColumn("t", split_title(F.col("text")))
    none = F.lit(None).cast("string")
    r = r.withColumns(
        {
            "title": F.col("t.title"),
            "description": F.col("t.description"),
            "quantity": F.col("qq.value"),
            "estimated": F.col("qq.estimated"),
            "unit_original": F.trim("m.u"),
            "unit": normalize_unit(F.col("m.u")),
            "manufacturer": none,
            "model_number": none,
            "article_number": none,
            "evidence": F.trim("line"),
            "warnings": F.array_compact(F.array(F.col("qq.warning"))),
        }
    )
    return _finish(r, 25, ["tender_id", "doc", "page", "row_no"])


def with_fallback(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """Items of tables; those of the text only for tenders without any."""
    cols = ["tender_id", "doc", "row_no", *_FIELDS]
    return tables.select(*cols).unionByName(texts.join(tables.select("tender_id").distinct(), "tender_id", "left_anti").select(*cols))


def dedup_key(position: Column, title: Column, q: Column) -> Column:
    return F.struct(
        F.coalesce(F.trim(position), F.lit("")).alias("p"), F.substring(normalize_text(title), 1, 80).alias("t"), F.format_string("%.3f", q.cast("double")).alias("q")
    )


def deduplicate(items: DataFrame, order: str = "ord") -> DataFrame:
    """The most confident of a tender's equal items, the first of equals, at the place of the first."""
    k = items.withColumn("k", dedup_key(F.col("position"), F.col("title"), F.col("quantity")))
    w = W.partitionBy("tender_id", "k")
    best = k.withColumn("first_ord", F.min(order).over(w)).withColumn("n_merged", F.count(F.lit(1)).over(w))
    best = best.withColumn("nth", F.row_number().over(w.orderBy(F.col("confidence").desc(), order))).where("nth = 1")
    return best.drop("k", "nth")


def position_parts(position: Column) -> Column:
    """Numbers of a position, so that 1.9 comes before 1.10; arrays compare element by element."""
    return F.transform(F.filter(F.split(position, "[./-]"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))


def natural_rank(items: DataFrame, *last: str) -> DataFrame:
    """Ordinal within a tender: by position, those without one last, then by title."""
    missing = F.col("position").isNull()
    w = W.partitionBy("tender_id").orderBy(missing, position_parts(F.col("position")).asc_nulls_last(), normalize_text(F.col("title")), *last)
    return items.withColumn("ordinal", F.row_number().over(w))


def run_summary(items: DataFrame) -> DataFrame:
    """A row a tender: items, priceable ones, mean confidence (half to even), whether all quantities are known."""
    priceable = (F.trim("title") != "") & F.col("quantity").isNotNull() & F.col("unit").isNotNull()
    return items.groupBy("tender_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(priceable).alias("n_priceable"),
        F.bround(F.avg("confidence"), 0).cast("int").alias("mean_confidence"),
        F.bool_and(F.col("quantity").isNotNull()).alias("all_quantities"),
    )
