"""Dates and deadlines as Column expressions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura.functions import constants as C

# Date formats, tried in order.
FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "d.M.yyyy", "d/M/yyyy", "yyyy/M/d")


def parse_date(x: Column) -> Column:
    """The local date of a text, without shift of its offset; unreadable is null."""
    core = F.regexp_replace(F.regexp_extract(F.trim(x), r"^([^T ]*)", 1), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.coalesce(*[F.try_to_date(core, f) for f in FORMATS])


def parse_datetime(x: Column) -> Column:
    """ISO time with offset (UTC without one), else a date at midnight."""
    iso = F.when(F.trim(x).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), F.try_to_timestamp(F.trim(x)))
    return F.coalesce(iso, parse_date(x).cast("timestamp"))


def local_deadline(x: Column, zone: str = "Europe/Berlin") -> Column:
    """A local time written ISO or ``d.m.yyyy[, hh:mm]``, as UTC; unreadable is null."""
    day = F.regexp_extract(x, r"(\d{1,2}\.\d{1,2}\.\d{4})", 1)
    clock = F.coalesce(F.nullif(F.regexp_extract(x, r"\d{4}\D{1,3}(\d{1,2}:\d{2})", 1), F.lit("")), F.lit("00:00"))
    iso = F.when(F.trim(x).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.trim(x)))
    return F.to_utc_timestamp(F.coalesce(iso, F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("d.M.yyyy H:mm"))), zone)


def deadlines(*texts: Column) -> Column:
    """``struct(submission, binding, delivery)``: of each kind the first date readable in the texts, in order."""
    found = []
    for kind, pattern in C.DEADLINES.items():
        found.append(F.coalesce(*[F.try_to_date(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")), "d.M.yyyy") for t in texts]).alias(kind))
    return F.struct(*found)


def days_until(deadline: Column, as_of: Column) -> Column:
    """Whole periods of 24 hours left, rounded down; negative once it has passed."""
    micros = F.unix_micros(deadline.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")
