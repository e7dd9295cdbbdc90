"""Notices out of landed files: lists, recorded API responses, feeds, HTML result lists; all into one schema."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procura.functions import amounts, dates, text
from procura.operators.search import Query, search

DOCUMENT = "struct<name:string,url:string,media_type:string,access:string>"
COLUMNS = {
    "id": "string", "source": "string", "source_id": "string", "source_url": "string", "national_id": "string", "title": "string", "authority": "string",
    "description": "string", "country": "string", "region": "string", "cpv_codes": "array<string>", "notice_type": "string", "procedure_type": "string",
    "publication_date": "date", "deadline": "timestamp", "binding_period_end": "date", "delivery_date": "date", "estimated_value": "double",
    "currency": "string", "status": "string", "lots": "array<string>", "delivery_location": "string", "documents": f"array<{DOCUMENT}>", "notes": "array<string>",
}


def _schema(df: DataFrame, **cols: Column) -> DataFrame:
    """All columns of a notice; what a source does not say is null."""
    return df.select(*[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


_LIST = (
    "source_id string, id string, national_id string, title string, contracting_authority string, description string, country string, region string, "
    "cpv_codes array<string>, notice_type string, procedure_type string, publication_date string, submission_deadline string, estimated_value double, "
    f"currency string, status string, source_url string, lots array<string>, delivery_location string, documents array<{DOCUMENT}>"
)


def read_list(spark: SparkSession, path: str, name: str = "fixture", query: Query | None = None, limit: int | None = None) -> DataFrame:
    """A JSON file with ``tenders``, or a bare list; ids fall back to ``id`` and then to the place in the
    file, with the file's name where there are several."""
    files = spark.read.text(path, wholetext=True)
    raw = files.select(
        F.lit("").alias("file") if len(files.inputFiles()) < 2 else F.concat(F.lit("@"), F.substring_index(F.input_file_name(), "/", -1)).alias("file"),
        F.coalesce(
            F.from_json("value", f"struct<tenders:array<struct<{_ddl(_LIST)}>>>")["tenders"], F.from_json("value", f"array<struct<{_ddl(_LIST)}>>")
        ).alias("t"),
    )
    t = raw.select("file", F.posexplode("t").alias("no", "t")).select("file", "no", "t.*")
    sid = F.coalesce("source_id", "id", F.concat(F.col("no").cast("string"), F.col("file")))
    out = _schema(
        t,
        id=text.tender_id(F.lit(name), sid), source=F.lit(name), source_id=sid, source_url=F.col("source_url"), national_id=F.col("national_id"),
        title=F.col("title"), authority=F.col("contracting_authority"), description=F.col("description"), country=F.col("country"), region=F.col("region"),
        cpv_codes=text.clean_codes(F.col("cpv_codes")), notice_type=F.col("notice_type"), procedure_type=F.col("procedure_type"),
        publication_date=dates.parse_date(F.col("publication_date")), deadline=dates.parse_datetime(F.col("submission_deadline")),
        estimated_value=F.col("estimated_value"), currency=F.col("currency"), status=F.coalesce("status", F.lit("UNKNOWN")), documents=F.col("documents"),
        lots=F.col("lots"), delivery_location=F.col("delivery_location"),
    )
    out = search(out, query) if query else out
    return out.orderBy("id").limit(limit) if limit else out


def _ddl(fields: str) -> str:
    return ",".join(re.sub(r"^(\w+) ", r"\1:", f.strip()) for f in re.split(r",\s*(?=\w+ )", fields))


#: Values come as texts, lists, or either by language, so that all are read as JSON and taken apart later.
_API = ",".join(
    f"`{k}`:string"
    for k in (
        "publication-number publicationNumber notice-title description-lot buyer-name buyer-country place-of-performance notice-type procedure-type "
        "publication-date deadline-receipt-request deadline-receipt-tender classification-cpv total-value estimated-value-lot"
    ).split()
) + ",links:struct<html:map<string,string>,htmlDirect:map<string,string>,pdf:map<string,string>,xml:map<string,string>>"
# Beginnings of notice types, in order, and the status they stand for.
STATUS = {"cn-": "OPEN", "pin-": "OPEN", "qs-": "OPEN", "subco": "OPEN", "can-": "AWARDED", "corr": "AMENDED", "change": "AMENDED"}


def status_of(notice_type: Column, deadline: Column, as_of: Column, mapping: dict[str, str] = STATUS) -> Column:
    """By the type's beginning; an open notice whose deadline has passed is closed; without a known type the deadline decides."""
    mapped = F.lit(None).cast("string")
    for prefix, name in reversed(list(mapping.items())):
        mapped = F.when(F.startswith(F.lower(notice_type), F.lit(prefix)), F.lit(name)).otherwise(mapped)
    by_deadline = F.when(deadline.isNull(), "UNKNOWN").when(deadline > as_of, "OPEN").otherwise("CLOSED")
    return F.when(mapped.isNull(), by_deadline).when((mapped == "OPEN") & (deadline <= as_of), "CLOSED").otherwise(mapped)


def expert_query(q: Query, fields: dict[str, str], default_after: str) -> str:
    """The query text an API takes: keywords OR-ed, lists IN, bounds by day, all AND-ed."""
    parts = []
    words = [k.strip() for k in q.keywords if k.strip()]
    if words and "fulltext" in fields:
        parts.append("(" + " OR ".join(f'{fields["fulltext"]} ~ ("{w}")' for w in words) + ")")
    for values, name in ((q.cpv_codes, "cpv"), (tuple(c.upper() for c in q.countries), "country")):
        some = " ".join(v.strip() for v in values if v.strip())
        if some and name in fields:
            parts.append(f"{fields[name]} IN ({some})")
    if "publication_date" in fields:
        parts.append(f"{fields['publication_date']} >= {q.published_after:%Y%m%d}" if q.published_after else f"{fields['publication_date']} >= {default_after}")
        if q.published_before:
            parts.append(f"{fields['publication_date']} <= {q.published_before:%Y%m%d}")
    if q.deadline_after is not None and "deadline" in fields:
        parts.append(f"{fields['deadline']} >= {q.deadline_after:%Y%m%d}")
    return " AND ".join(parts)


def read_api(spark: SparkSession, path: str, as_of: Column, name: str = "api", base: str = "https://example.invalid/notice/") -> DataFrame:
    """Recorded responses, one JSON object a file: ``notices``, ``results`` or ``data``; none of them is an error.

    Values may be texts, lists, or either by language.  Notices without a number are dropped, and of a number all but
    the first, by file and place.
    """
    one = f"array<struct<{_API}>>"
    raw = spark.read.text(path, wholetext=True)
    raw = raw.select(F.input_file_name().alias("file"), F.from_json("value", f"struct<notices:{one},results:{one},data:{one}>").alias("r"))
    found = F.coalesce("r.notices", "r.results", "r.data", F.raise_error(F.lit("a response has no list of notices")).cast(one))
    n = raw.select("file", F.posexplode(found).alias("no", "n"))
    said = lambda k: text.first_text(text.texts_of(F.col(f"`{k}`")))
    number = F.coalesce(text.blank_to_null(F.col("n.`publication-number`")), text.blank_to_null(F.col("n.publicationNumber")))
    n = n.withColumn("number", number).where("number IS NOT NULL").groupBy("number").agg(F.min_by("n", F.struct("file", "no")).alias("n"))
    n = n.select("number", "n.*")
    deadline = dates.parse_datetime(F.coalesce(said("deadline-receipt-request"), said("deadline-receipt-tender")))
    value = amounts.money(F.coalesce("`total-value`", "`estimated-value-lot`"))
    link = lambda k: F.get(F.filter(F.map_values(f"links.{k}"), lambda u: F.trim(u) != ""), F.lit(0))
    doc = lambda k, m: F.when(link(k).isNotNull(), F.struct(F.lit(f"Notice ({k.upper()})").alias("name"), link(k).alias("url"), F.lit(m).alias("media_type"), F.lit("PUBLIC").alias("access")))
    return _schema(
        n,
        id=text.tender_id(F.lit(name), F.col("number")), source=F.lit(name), source_id=F.col("number"), national_id=F.col("number"),
        source_url=F.coalesce(link("html"), link("htmlDirect"), F.concat(F.lit(base), F.col("number"))), title=said("notice-title"),
        authority=said("buyer-name"), description=text.strip_html(said("description-lot")),
        country=said("buyer-country"), region=said("place-of-performance"), cpv_codes=text.clean_codes(F.array_distinct(text.as_list(F.col("`classification-cpv`")))), notice_type=said("notice-type"),
        procedure_type=said("procedure-type"), publication_date=dates.parse_date(said("publication-date")), deadline=deadline,
        estimated_value=value["value"], currency=value["currency"], status=status_of(said("notice-type"), deadline, as_of),
        documents=F.array_compact(F.array(doc("pdf", "application/pdf"), doc("xml", "application/xml"))),
    )


def _feed_files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """``path, x, error`` of feed files: the text in the declared encoding, or why it is not read."""
    f = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    head = F.decode(F.substring("content", 1, 200), "ISO-8859-1")
    declared = F.lower(F.regexp_extract(head, r"^[^<]*<\?xml[^>]*encoding=[\"']([\w-]+)", 1))
    x = F.when(declared.isin("iso-8859-1", "latin1", "windows-1252"), F.decode("content", "ISO-8859-1")).otherwise(F.decode("content", "UTF-8"))
    f = f.select("path", "length", F.when(F.col("length") <= max_bytes, x).alias("x"))
    error = (
        F.when(F.col("x").isNull(), F.lit("the feed is too large"))
        .when(F.col("x").rlike("(?i)<!(DOCTYPE|ENTITY)"), F.lit("the feed declares a document type"))
        .when(~F.col("x").rlike(r"(?i)<(rss|feed|rdf:RDF)\b"), F.lit("the file is no feed"))
    )
    return f.select("path", error.alias("error"), F.when(error.isNull(), F.col("x")).alias("x"))


def feed_failures(spark: SparkSession, path: str, max_bytes: int = 10_000_000) -> DataFrame:
    """``path, error`` of the files that ``read_feed`` leaves out."""
    return _feed_files(spark, path, max_bytes).where("error IS NOT NULL").select("path", "error")


def read_feed(spark: SparkSession, path: str, name: str = "feed", country: str | None = None, authority: str | None = None, max_bytes: int = 10_000_000) -> DataFrame:
    """Items of RSS files and entries of Atom files.

    Files over ``max_bytes``, with document type declarations or that are no feeds are left out before they are parsed;
    ``feed_failures`` has them.
    """
    files = _feed_files(spark, path, max_bytes)
    none = F.array().cast("array<string>")
    tags = lambda t: F.regexp_extract_all("x", F.lit(rf"(?s)(<{t}\b.*?</{t}>)"), F.lit(1))
    item = T._parse_datatype_string("title string, link string, guid string, description string, pubDate string")
    entry = T._parse_datatype_string(
        "title string, link array<struct<_href:string,_rel:string>>, id string, summary string, content string, published string, updated string"
    )
    parsed = files.select(
        F.inline(F.concat(
            F.transform(F.coalesce(tags("item"), none), lambda x: F.struct(x.alias("xml"), F.lit(False).alias("atom"))),
            F.transform(F.coalesce(tags("entry"), none), lambda x: F.struct(x.alias("xml"), F.lit(True).alias("atom"))),
        ))
    )
    plain = F.regexp_replace("xml", r"(?s)<(/?)content\b[^>]*>", "<$1content>")
    parsed = parsed.select(
        F.when(~F.col("atom"), F.from_xml("xml", item, {"rowTag": "item"})).alias("r"), F.when(F.col("atom"), F.from_xml(plain, entry, {"rowTag": "entry"})).alias("a")
    )
    main = F.filter("a.link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    i = parsed.select(
        F.coalesce("r.title", "a.title").alias("title"), F.coalesce("r.link", F.get(main, F.lit(0))["_href"]).alias("link"), F.coalesce("r.guid", "a.id").alias("guid"),
        F.coalesce("r.description", "a.summary", "a.content").alias("description"), F.coalesce("r.pubDate", "a.published", "a.updated").alias("pubDate"),
    )
    raw_id = F.coalesce("guid", "link")
    sid = F.substring(F.sha2(raw_id, 256), 1, 24)
    title, about = text.strip_html(F.col("title")), text.strip_html(F.col("description"))
    d = dates.deadlines(F.coalesce(title, F.lit("")), F.coalesce(about, F.lit("")))
    published = F.coalesce(F.try_to_date(F.regexp_extract("pubDate", r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), "d MMM yyyy"), dates.parse_date(F.col("pubDate")))
    return _schema(
        i,
        id=text.tender_id(F.lit(name), sid), source=F.lit(name), source_id=sid, source_url=F.col("link"), title=title, description=about,
        country=F.lit(country), authority=F.lit(authority), publication_date=published, deadline=d["submission"].cast("timestamp"),
        binding_period_end=d["binding"], delivery_date=d["delivery"], status=F.lit("OPEN"),
    )


@dataclass(frozen=True)
class Selector:
    """Where a field stands in a row: selector (tag, .class, #id, descendants, :nth-of-type), attribute, regex."""

    selector: str = ""
    attribute: str = "text"
    regex: str | None = None
    index: int = 0


@dataclass
class _Node:
    tag: str
    attrs: dict[str, str]
    parent: _Node | None = None
    nth: int = 1
    children: list = field(default_factory=list)

    def text(self) -> str:
        out = []
        for c in self.children:
            s = c.text() if isinstance(c, _Node) else c.strip()
            if s:
                out.append(" ".join(s.split()))
        return " ".join(out)

    def walk(self):
        for c in self.children:
            if isinstance(c, _Node):
                yield c
                yield from c.walk()


class _Tree(HTMLParser):
    VOID = set("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {})

    def handle_starttag(self, tag, attrs):
        nth = 1 + sum(isinstance(c, _Node) and c.tag == tag for c in self.at.children)
        n = _Node(tag, {k: v or "" for k, v in attrs}, self.at, nth)
        self.at.children.append(n)
        if tag not in self.VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


_PART = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|:nth-of-type\(\d+\))*)$")


def select(root: _Node, selector: str) -> list[_Node]:
    steps = []
    for part in selector.split():
        m = _PART.match(part)
        if not m:
            raise ValueError(f"selector not understood: {part}")
        steps.append((m[1], re.findall(r"[.#][\w-]+|:nth-of-type\(\d+\)", m[2])))

    def fits(n: _Node, step) -> bool:
        tag, marks = step
        if tag and tag != "*" and n.tag != tag.lower():
            return False
        for k in marks:
            if k[0] == "." and k[1:] not in n.attrs.get("class", "").split():
                return False
            if k[0] == "#" and n.attrs.get("id") != k[1:]:
                return False
            if k[0] == ":" and n.nth != int(k[13:-1]):
                return False
        return True

    out = []
    for n in root.walk():
        if fits(n, steps[-1]):
            up, left = n.parent, steps[:-1]
            while left and up is not None and up is not root:
                if fits(up, left[-1]):
                    left = left[:-1]
                up = up.parent
            if not left:
                out.append(n)
    return out


def parse_list(html: str, row: str, fields: dict[str, Selector], required: tuple[str, ...]) -> list[dict]:
    """Field texts of each row of a result list that has all required ones."""
    tree = _Tree()
    tree.feed(html)
    out = []
    for n in select(tree.root, row):
        values = {}
        for name, s in fields.items():
            found = select(n, s.selector) if s.selector else [n]
            value = None
            if len(found) > s.index:
                e = found[s.index]
                value = (e.text() if s.attribute == "text" else e.attrs.get(s.attribute, "")).strip() or None
            if value and s.regex:
                m = re.search(s.regex, value)
                value = ((m[1] if m.groups() else m[0]).strip() or None) if m else None
            values[name] = value
        if all(values.get(r) for r in required):
            out.append(values | {"evidence": n.text()[:1000]})
    return out


_FIELDS = ("title", "contracting_authority", "description", "national_id", "region", "cpv_codes", "notice_type", "procedure_type", "publication_date", "submission_deadline", "estimated_value", "currency", "detail_url", "evidence")


def html_rows(files: DataFrame, row: str, fields: dict[str, Selector], required: tuple[str, ...] = ("title",)) -> DataFrame:
    """``files(path, html)`` to a row for each hit, field texts as they stand; one Arrow pass."""

    def parsed(batches):
        for b in batches:
            out = [{"path": p} | r for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in parse_list(h or "", row, fields, required)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], pa.string()) for c in ("path", *_FIELDS)], ["path", *_FIELDS])

    return files.select("path", "html").mapInArrow(parsed, ", ".join(f"{c} string" for c in ("path", *_FIELDS)))


def notices_of_rows(rows: DataFrame, name: str, base_url: str, id_param: str | None = None, zone: str = "Europe/Berlin", country: str | None = None, authority: str | None = None) -> DataFrame:
    """Notices of ``html_rows``: a stable id (number, parameter of the link, hash), local deadline, notes where it is unreadable."""
    join = F.udf(lambda u: urljoin(base_url + "/", u) if u else None, "string")
    absolute = F.when(F.col("detail_url").rlike("^[a-z]+://"), F.col("detail_url")).otherwise(join("detail_url"))
    r = rows.withColumn("url", absolute)
    param = F.expr(f"url_decode(try_parse_url(url, 'QUERY', '{id_param}'))") if id_param else F.lit(None).cast("string")
    named = F.concat_ws("|", "title", "contracting_authority")
    sid = F.coalesce(
        F.substring(text.blank_to_null(F.col("national_id")), 1, 120), F.substring(text.blank_to_null(param), 1, 120),
        F.substring(F.sha2("url", 256), 1, 24), F.substring(F.sha2(named, 256), 1, 24),
    )
    deadline = dates.local_deadline(F.col("submission_deadline"), zone)
    note = F.when(F.col("submission_deadline").isNotNull() & deadline.isNull(), F.concat(F.lit("deadline unreadable: "), F.col("submission_deadline")))
    note = note.when(deadline.isNotNull(), F.lit(f"deadline read as local time ({zone})"))
    return _schema(
        r,
        id=text.tender_id(F.lit(name), sid), source=F.lit(name), source_id=sid, source_url=F.coalesce("url", "path"), national_id=F.col("national_id"),
        title=F.col("title"), authority=F.coalesce("contracting_authority", F.lit(authority)), description=F.col("description"), country=F.lit(country),
        region=F.col("region"), cpv_codes=text.cpv_codes(F.col("cpv_codes")), notice_type=F.col("notice_type"), procedure_type=F.col("procedure_type"),
        publication_date=dates.parse_date(F.col("publication_date")), deadline=deadline, estimated_value=amounts.amount(F.col("estimated_value"))["value"],
        currency=amounts.currency(F.coalesce("currency", "estimated_value")), status=F.lit("OPEN"), notes=F.array_compact(F.array(note)),
    )


def enrich(notices: DataFrame, details: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Fills only what is null from ``details(id, ...)``; a notice without details stays as it is."""
    n, d = notices.alias("n"), details.alias("d")
    return n.join(d, F.col("n.id") == F.col("d.id"), "left").select(*[F.coalesce(f"n.{c}", f"d.{c}").alias(c) if c in cols else F.col(f"n.{c}") for c in notices.columns])
