"""Filters, listings, look-ups and overviews over notices."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from procura.functions.dates import days_until
from procura.functions.text import display, let, normalize_text


@dataclass(frozen=True)
class Query:
    keywords: tuple[str, ...] = ()
    cpv_codes: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    published_after: date | None = None
    published_before: date | None = None
    deadline_after: object | None = None


def tolerant(condition: Column, *needed: Column) -> Column:
    """True where a needed value is missing: only a contradiction excludes."""
    out = condition
    for x in needed:
        out = x.isNull() | out
    return out


def keyword_match(keywords: tuple[str, ...], *texts: Column) -> Column:
    """Any normalised keyword is part of the normalised texts; no text matches no keyword, an empty keyword any."""
    def found(haystack: Column) -> Column:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(haystack, normalize_text(F.lit(k)))
        return (haystack != "") & hit

    return let(normalize_text(F.concat_ws(" ", *texts)), found)


def code_match(wanted: tuple[str, ...], codes: Column) -> Column:
    """Codes of a hierarchy: one is the other's beginning, trailing zeros aside; no code at all passes."""
    hit = F.lit(False)
    for w in wanted:
        stem = w[:8].rstrip("0")
        hit = hit | F.exists(codes, lambda c: F.startswith(F.lit(stem), F.rtrim(F.substring(c, 1, 8), F.lit("0"))) | F.startswith(F.rtrim(F.substring(c, 1, 8), F.lit("0")), F.lit(stem)))
    return codes.isNull() | (F.size(codes) == 0) | hit


def search(notices: DataFrame, q: Query) -> DataFrame:
    """Notices (``title, description, authority, cpv_codes, country, publication_date, deadline``) that fit ``q``."""
    out = notices
    if q.keywords:
        out = out.where(keyword_match(q.keywords, F.col("title"), F.col("description"), F.col("authority")))
    if q.cpv_codes:
        out = out.where(code_match(q.cpv_codes, F.col("cpv_codes")))
    if q.countries:
        out = out.where(tolerant(F.upper("country").isin(*[c.upper() for c in q.countries]), F.col("country")))
    day = F.col("publication_date")
    if q.published_after is not None:
        out = out.where(tolerant(day >= F.lit(q.published_after), day))
    if q.published_before is not None:
        out = out.where(tolerant(day <= F.lit(q.published_before), day))
    if q.deadline_after is not None:
        out = out.where(tolerant(F.col("deadline") >= F.lit(q.deadline_after), F.col("deadline")))
    return out


ORDERS = {
    "deadline": lambda: [F.col("deadline").asc_nulls_last()],
    "published": lambda: [F.col("publication_date").desc_nulls_last()],
    "value": lambda: [F.col("estimated_value").desc_nulls_last()],
    "seen": lambda: [F.col("last_seen_at").desc_nulls_last()],
}


def list_notices(
    notices: DataFrame,
    *,
    as_of: Column,
    sources: tuple[str, ...] = (),
    status: str | None = None,
    text: str | None = None,
    open_only: bool = False,
    min_days: int | None = None,
    order: str = "deadline",
    offset: int = 0,
    limit: int | None = None,
    primary_only: bool = False,
) -> DataFrame:
    """A page of notices in a total order that ends with the id; ``%`` and ``_`` in ``text`` are wildcards."""
    out = notices
    if primary_only:
        out = out.where("is_primary")
    if sources:
        out = out.where(F.col("source").isin(*sources))
    if status:
        out = out.where(F.col("status") == status)
    if text:
        like = f"%{text.lower()}%"
        out = out.where(F.lower("title").like(like) | F.lower("authority").like(like))
    if open_only:
        out = out.where(F.col("deadline").isNull() | (F.col("deadline") >= as_of))
    if min_days is not None:
        out = out.where(days_until(F.col("deadline"), as_of) >= min_days)
    out = out.orderBy(*ORDERS[order](), "id")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def lookup(notices: DataFrame, key: Column) -> DataFrame:
    """One notice: by id, else the first by source id in order of id."""
    rank = F.when(F.col("id").cast("string") == key, 0).when(F.col("source_id").cast("string") == key, 1)
    return notices.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "id").limit(1).drop("rank")


def statistics(notices: DataFrame, as_of: Column) -> DataFrame:
    """Totals, primary and open ones, and numbers by source, in one aggregation."""
    is_open = F.col("deadline").isNull() | (F.col("deadline") >= as_of)
    per = notices.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_primary").alias("p"), F.count_if(F.col("is_primary") & is_open).alias("o")
    )
    return per.select(
        "source",
        F.col("n").alias("by_source"),
        F.sum("n").over(W.partitionBy()).alias("tenders_total"),
        F.sum("p").over(W.partitionBy()).alias("tenders_primary"),
        F.sum("o").over(W.partitionBy()).alias("tenders_open"),
    )


def export_rows(notices: DataFrame, as_of: Column) -> DataFrame:
    """What an export shows: markers for what is missing, times to the minute."""
    return notices.select(
        F.col("id"),
        display(F.col("title")).alias("title"),
        display(F.col("authority")).alias("authority"),
        display(F.col("country")).alias("country"),
        display(F.col("status")).alias("status"),
        display(F.col("publication_date")).alias("publication_date"),
        display(F.col("deadline"), "time").alias("deadline"),
        display(days_until(F.col("deadline"), as_of)).alias("days_left"),
        display(F.col("estimated_value").cast("decimal(18,2)")).alias("estimated_value"),
        display(F.col("cpv_codes"), "list").alias("cpv_codes"),
    )
