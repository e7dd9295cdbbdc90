"""Amounts, currencies, rates and price tiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura.functions import constants as C
from procura.functions.text import blank_to_null, let


def _token(x: Column) -> Column:
    t = F.nullif(F.regexp_extract(x, r"(?U)(-?\d[\d.,'\s ]*)", 1), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)^[\s ]+|[\s ]+$", ""), "[.,]+$", "")
    t = F.regexp_replace(t, r"(?U)(?<=\d)[\s '](?=\d{3}(?!\d))", "")
    # Blanks that group nothing end the number.
    first = F.regexp_replace(F.regexp_replace(t, r"(?U)[\s ].*$", ""), "[.,]+$", "")
    return F.replace(first, F.lit("'"), F.lit(""))


def amount(x: Column) -> Column:
    """``struct(value double, confidence int)`` of the first number in a text, in German or English spelling.

    Of both separators the last is the decimal one; a repeated one groups; one before exactly three digits groups and
    is ambiguous (confidence 60); any other is decimal.  No number: null and 0.
    """
    return let(_token(x), _read)


def _read(t: Column) -> Column:
    dot, comma = F.contains(t, F.lit(".")), F.contains(t, F.lit(","))
    last_dot = F.length(F.substring_index(t, ".", -1)) < F.length(F.substring_index(t, ",", -1))
    both = F.when(last_dot, F.replace(t, F.lit(","), F.lit(""))).otherwise(
        F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    )
    plain = F.translate(t, ".,", "")
    n_sep = F.length(t) - F.length(plain)
    tail = F.regexp_extract(t, r"[.,]([^.,]*)$", 1)
    head = F.regexp_extract(t, r"^-*([^.,]*)", 1)
    three = (n_sep == 1) & (F.length(tail) == 3) & (head != "")
    single = F.when((n_sep > 1) | three, plain).otherwise(F.translate(t, ",", "."))
    number = F.when(dot & comma, both).when(dot | comma, single).otherwise(t)
    sure = F.when((dot | comma) & ~(dot & comma) & three, 60).otherwise(100)
    value = let(number, lambda n: F.when(n.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), n.try_cast("double")))
    return let(value, lambda v: F.struct(v.alias("value"), F.when(v.isNull(), 0).otherwise(sure).alias("confidence")))


def money(raw: Column) -> Column:
    """``struct(value double, currency string)`` of a JSON value: a number, a text, an object or a list of them (the first)."""
    first = F.when(F.startswith(raw, F.lit("[")), F.get(F.from_json(raw, "array<string>"), F.lit(0))).otherwise(raw)

    def read(v: Column) -> Column:
        o = F.when(F.startswith(v, F.lit("{")), F.from_json(v, "struct<amount:string,value:string,currency:string,currencyCode:string>"))
        inner = F.coalesce(o["amount"], o["value"], F.when(o.isNull(), v))
        code = F.upper(F.coalesce(o["currency"], o["currencyCode"], currency(F.when(o.isNull(), v))))
        return F.struct(F.coalesce(inner.try_cast("double"), amount(inner)["value"]).alias("value"), code.alias("currency"))

    return let(first, read)


def currency(x: Column) -> Column:
    named = F.nullif(F.upper(F.regexp_extract(x, r"(?iU)\b(" + "|".join(C.CURRENCIES) + r")\b", 1)), F.lit(""))
    bare = F.when(F.trim(x).rlike(r"(?U)^\p{Alpha}{3}$"), F.upper(F.trim(x)))
    return F.coalesce(named, bare, F.when(F.contains(x, F.lit("€")), F.lit("EUR")))


def rate(x: Column) -> Column:
    """A tax rate as a share: 19, 19 % and 0,19 are 0.19; negative is null."""
    return let(amount(x)["value"], lambda v: F.when(v > 1.0, v / 100.0).when(v >= 0, v))


def tiers(x: Column) -> Column:
    """``array<struct<min_quantity, amount>>`` of ``50:179,00|100:172,50``, by quantity; unreadable parts go."""
    parts = F.split(F.replace(x, F.lit("|"), F.lit(";")), ";")
    read = F.transform(
        F.filter(parts, lambda p: F.contains(p, F.lit(":"))),
        lambda p: F.struct(
            amount(F.substring_index(p, ":", 1))["value"].alias("min_quantity"),
            amount(F.regexp_replace(p, "^[^:]*:", ""))["value"].alias("amount"),
        ),
    )
    good = F.filter(read, lambda t: t["min_quantity"].isNotNull() & t["amount"].isNotNull())
    return F.array_sort(F.coalesce(good, F.array().cast("array<struct<min_quantity:double,amount:double>>")))


def amount_for(base: Column, tier: Column, quantity: Column) -> Column:
    """The least amount of the tiers that the quantity reaches, the base amount without any."""
    fit = F.filter(tier, lambda t: quantity >= t["min_quantity"])
    return F.coalesce(F.array_min(F.transform(fit, lambda t: t["amount"])), base)


def net_amount(value: Column, basis: Column, vat: Column) -> Column:
    """``struct(net, reason)``: net stays, gross is divided by 1 + rate, anything else is null with a reason."""
    net = F.when(basis == "NET", value).when((basis == "GROSS") & vat.isNotNull(), value / (1 + vat))
    reason = (
        F.when(value.isNull(), F.lit("no amount"))
        .when(basis == "NET", F.lit(None))
        .when((basis == "GROSS") & vat.isNull(), F.lit("gross price without tax rate"))
        .when(basis == "GROSS", F.lit(None))
        .otherwise(F.lit("price basis unknown"))
    )
    return F.struct(net.alias("net"), reason.alias("reason"))


def word_class(x: Column, words: dict[str, str]) -> Column:
    """Class of the longest word of ``words`` contained in ``x``, umlauts written out; UNKNOWN without one.

    The longest decides because "nicht verfuegbar" contains "verfuegbar".
    """
    key = F.regexp_replace(F.replace(F.lower(x), F.lit("."), F.lit(" ")), r"(?U)\s+", " ")
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        key = F.replace(key, F.lit(a), F.lit(b))
    out = F.lit("UNKNOWN")
    for w in sorted(words, key=len):
        out = F.when(F.contains(key, F.lit(w)), F.lit(words[w])).otherwise(out)
    return F.when(blank_to_null(x).isNull(), F.lit("UNKNOWN")).otherwise(out)


def price_basis(x: Column) -> Column:
    return word_class(x, C.BASIS)


def availability(x: Column) -> Column:
    return word_class(x, C.AVAILABILITY)
