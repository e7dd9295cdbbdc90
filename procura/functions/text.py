"""Text as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura.functions import constants as C
from procura.params import DEFAULTS


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters that fold to one character, that one, and those that fold to several, by Unicode's compatibility rules."""
    one, to, more = [], [], []
    for c in map(chr, [*range(0xA1, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFB00, 0xFB07)]):
        folded = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if folded != c and c == c.lower() and c not in "äöüß":
            if len(folded) == 1:
                one.append(c)
                to.append(folded)
            elif len(folded) > 1:
                more.append((c, folded))
    return "".join(one), "".join(to), more


_FROM, _TO, _SEVERAL = _folds()
_LIGATURES = [(a, b) for a, b in _SEVERAL if unicodedata.category(a).startswith("L")]


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` names it: expressions stay small when they are nested."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def normalize_text(x: Column) -> Column:
    """Lower case, umlauts written out, accents off, digit grouping and punctuation off, blanks collapsed; null is ''."""
    y = F.lower(F.coalesce(x, F.lit("")))
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        y = F.replace(y, F.lit(a), F.lit(b))
    for a, b in _LIGATURES:
        y = F.replace(y, F.lit(a), F.lit(b))
    y = F.regexp_replace(F.translate(y, _FROM, _TO), r"\p{M}", "")
    y = F.regexp_replace(y, r"(?U)(?<=\d)[.  ](?=\d{3}(?!\d))", "")
    y = F.regexp_replace(y, r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(y, r"(?U)\s+", " "))


def normalize_identifier(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def strip_html(x: Column) -> Column:
    """Without tags, with six entities decoded in order; blank is null."""
    y = F.regexp_replace(x, "<[^>]+>", " ")
    for a, b in C.ENTITIES:
        y = F.replace(y, F.lit(a), F.lit(b))
    return blank_to_null(F.regexp_replace(y, r"(?U)\s+", " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def stem(t: Column) -> Column:
    out = t
    for ending in reversed(C.ENDINGS):
        n = len(ending)
        fits = (F.length(t) > C.MIN_STEM) & F.endswith(t, F.lit(ending)) & (F.length(t) - n >= C.MIN_STEM)
        out = F.when(fits, F.substring(t, F.lit(1), F.length(t) - n)).otherwise(out)
    return out


def tokens(x: Column) -> Column:
    """Distinct stems of the words of two letters or more that tell products apart; stop words go before stemming."""
    words = F.regexp_extract_all(normalize_text(x), F.lit("[a-z0-9]+"), F.lit(0))
    some = F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*C.STOPWORDS))
    return F.array_distinct(F.transform(some, stem))


def overlap(left: Column, right: Column) -> Column:
    """Shared tokens over those of the shorter set of two token arrays; 0 if either is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / least)


def blocking_key(title: Column, authority: Column) -> Column:
    words = F.slice(F.split(normalize_text(title), " "), 1, DEFAULTS.block_title_words)
    return F.concat(F.substring(normalize_text(authority), 1, DEFAULTS.block_authority_chars), F.lit("|"), F.array_join(words, " "))


def fingerprint(national_id: Column, title: Column, authority: Column, deadline: Column) -> Column:
    """Hash of the national number if there is one, else of title, authority and the deadline's date."""
    by_number = F.concat(F.lit("nid:"), normalize_text(national_id))
    day = F.coalesce(F.date_format(deadline, "yyyy-MM-dd"), F.lit(""))
    parts = F.concat_ws("|", normalize_text(title), normalize_text(authority), day)
    return F.sha2(F.when(F.length(F.coalesce(national_id, F.lit(""))) > 0, by_number).otherwise(parts), 256)


def content_hash(*cols: Column) -> Column:
    """Hash that changes with any of the values; a null differs from every text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)


def tender_id(source: Column, source_id: Column) -> Column:
    return F.concat(source, F.lit(":"), source_id)


def clean_codes(codes: Column) -> Column:
    return F.filter(F.transform(codes, lambda c: F.trim(c)), lambda c: c != "")


def cpv_codes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(\d{8})(?:-\d)?\b"), F.lit(1))


def sentences(text: Column) -> Column:
    """Sentences of eight characters or more, blanks collapsed."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?;\n]+[.!?;]?"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))), lambda s: F.length(s) >= 8)


def shorten(sentence: Column) -> Column:
    n = C.EVIDENCE_CHARS
    return F.when(F.length(sentence) <= n, sentence).otherwise(F.concat(F.rtrim(F.substring(sentence, 1, n - 1)), F.lit("…")))


def display(x: Column, kind: str = "text") -> Column:
    """As shown to people: the marker for what is missing, lists joined, times to the minute."""
    if kind == "list":
        shown = F.array_join(x, ", ")
    elif kind == "time":
        shown = F.date_format(x, "yyyy-MM-dd HH:mm")
    else:
        shown = x.cast("string")
    return F.coalesce(F.when(F.trim(shown) != "", shown), F.lit(DEFAULTS.missing))


def german_number(x: Column, digits: int = 2) -> Column:
    return F.translate(F.format_number(x, digits), ",.", ".,")


_UNIT_KEYS = {a: u for u, spellings in C.UNITS.items() for a in spellings}


def _unit_map() -> Column:
    return F.create_map(*[F.lit(y) for pair in _UNIT_KEYS.items() for y in pair])


def unit_key(raw: Column) -> Column:
    y = F.translate(F.lower(F.trim(raw)), "²³", "23")
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        y = F.replace(y, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(y, r"(?U)[^\w%/ ]+", " "), r"(?U)\s+", " "))


def normalize_unit(raw: Column) -> Column:
    """Canonical unit or null: by the whole spelling, else by its last word."""
    return let(unit_key(raw), lambda key: F.coalesce(F.element_at(_unit_map(), key), F.element_at(_unit_map(), F.substring_index(key, " ", -1))))


def looks_like_unit(raw: Column) -> Column:
    return F.coalesce((F.length(F.trim(raw)) <= C.MAX_UNIT_LENGTH) & normalize_unit(raw).isNotNull(), F.lit(False))


def first_text(x: Column, languages: tuple[str, ...] = ("deu", "de", "eng", "en", "fra", "fr")) -> Column:
    """First text of ``map<language, array<string>>`` that is not blank: by language, else any."""
    some = lambda a: F.get(F.filter(a, lambda t: F.trim(t) != ""), F.lit(0))
    named = [some(F.element_at(x, F.lit(g))) for g in languages]
    return F.trim(F.coalesce(*named, some(F.flatten(F.map_values(x)))))


def texts_of(raw: Column) -> Column:
    """``map<language, array<string>>`` of a JSON value of any shape: a text, a list of texts, or either by language.

    ``raw`` is the value as Spark's JSON reader gives it for a string field: a text as it is, anything else as JSON.
    """
    listed = lambda v: F.when(F.startswith(v, F.lit("[")), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).otherwise(F.array(v))
    by_language = F.when(F.startswith(raw, F.lit("{")), F.from_json(raw, "map<string,string>"))
    named = F.transform_values(by_language, lambda _, v: F.filter(listed(v), lambda t: t.isNotNull()))
    return F.coalesce(named, F.when(raw.isNotNull(), F.create_map(F.lit(""), F.filter(listed(raw), lambda t: t.isNotNull()))))


def as_list(raw: Column) -> Column:
    """A JSON value as a list: null is empty, a list is itself, any other value is its only element."""
    none = F.array().cast("array<string>")
    return F.when(raw.isNull(), none).otherwise(F.filter(F.flatten(F.map_values(texts_of(raw))), lambda t: t.isNotNull()))


def all_texts(x: Column) -> Column:
    return F.filter(F.transform(F.flatten(F.map_values(x)), lambda t: F.trim(t)), lambda t: t != "")


def suffix_for(media_type: Column, url: Column) -> Column:
    known = {"application/pdf": ".pdf", "text/html": ".html", "text/plain": ".txt", "text/csv": ".csv", "application/zip": ".zip"}
    by_type = F.element_at(F.create_map(*[F.lit(y) for p in known.items() for y in p]), F.lower(F.substring_index(media_type, ";", 1)))
    by_url = F.lower(F.nullif(F.regexp_extract(F.substring_index(url, "?", 1), r"(\.[A-Za-z0-9]{1,5})$", 1), F.lit("")))
    return F.coalesce(by_type, by_url, F.lit(".bin"))


def safe_name(name: Column) -> Column:
    """A file name without anything but letters, digits, dot, dash and underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+", ""), 1, 120)
