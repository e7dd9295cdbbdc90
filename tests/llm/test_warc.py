"""WARC derivatives: round trips, identifiers, headers, hostile pages, input files."""

import gzip
import time

import pytest

from procura.llm import warc


def test_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    extra = [(None, None, None), (1, "http://x/\r\nWARC-Type: evil", ""), (2, "http://y", "<p>a &amp; b<br>c<script>no</script>"), (2, "http://y", "<p>other")]
    found = warc.responses(pages.union(spark.createDataFrame(extra, pages.schema)))
    source = {r.response_id: r.block for r in found.collect()}
    rows = warc.derivatives(found).collect()
    assert len(rows) == 2 * (pages.count() + 4)
    data = b"".join(bytes(r.record) for r in rows)
    for (head, block), r in zip(warc.parse(data), rows, strict=True):
        head = dict(head)
        assert block == bytes(r.block) and head["WARC-Type"] == r.record_type and head["WARC-Refers-To"] == r.refers_to
        assert head["WARC-Block-Digest"] == warc.digest(block) and int(head["Content-Length"]) == len(block)
        assert r.source_block_digest == warc.digest(bytes(source[r.refers_to]))
    assert len({r.record_id for r in rows}) == len(rows)
    text = {bytes(r.block).decode() for r in rows if r.record_type == "conversion" and r.target_uri == "http://y"}
    assert text == {"a & b\nc", "other"}
    every = [bytes(r.block).decode() for r in rows if r.record_type == "conversion"]
    assert all("track(" not in t and "<p>" not in t for t in every)
    assert warc.op5_warc(spark, sf_dir).count() == 2 * pages.count()


def test_awkward_pages(spark):
    schema = "page_id long, url string, html string, block string, `date` string"
    empty = spark.createDataFrame([], schema)
    assert warc.derivatives(warc.responses(empty)).count() == 0
    df = spark.createDataFrame([(1, "u", "<p>x</p>" * 200_000, "b", "2020-01-01T00:00:00Z"), (1, "u", None, None, None), (1, "u", None, None, None)], schema)
    rows = warc.derivatives(warc.responses(df, df["date"])).collect()
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 4  # the equal rows are one capture
    assert sum(b"WARC-Date: 2020-01-01" in bytes(r.record) for r in rows) == 2


def test_headers_are_kept_in_order():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/html\r\nSet-Cookie: b=2\r\nX-Z: q: r\r\n\r\n<title>T &amp; U</title><a href='x'>l</a>"
    meta, conversion = warc.derive("<urn:uuid:1>", "u", "d", block)
    assert meta["source_headers"] == "Set-Cookie: a=1\r\nContent-Type: text/html\r\nSet-Cookie: b=2\r\nX-Z: q: r"
    lines = meta["block"].decode().split("\r\n")
    assert lines[4:8] == ["source-header-Set-Cookie: a=1", "source-header-Content-Type: text/html", "source-header-Set-Cookie: b=2", "source-header-X-Z: q: r"]
    assert lines[8:10] == ["title: T & U", "n-outlinks: 1"] and conversion["block"] == b"T & U\nl"


@pytest.mark.parametrize("page", ["<!--" * 250_000, "<script>" * 120_000, "<a<a" * 250_000, "<title>" * 140_000, "</script " + " " * 900_000, "<p" * 500_000, "&" * 1_000_000])
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    warc.plain_text(page)
    assert time.time() - began < 4


def test_tags_and_comments():
    text, title, links = warc.plain_text("<html><head><TITLE>A\n b</TITLE><style>x{}</style></head><p>1 < 2 <!-- <p>no --> yes<td>c<td>d</p><A HREF=\"q\">e</A><a>f</a> end <b")
    assert (text, title, links) == ("A b\n1 < 2 yes c d\nef end <b", "A b", 1)


def test_files_are_read(spark, tmp_path):
    def record(kind, n, block):
        return warc.serialize([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{n}>"), ("WARC-Date", "2021-05-05T00:00:00Z"), ("WARC-Target-URI", f"http://h/{n}")], block)

    http = lambda n: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>page %d" % n
    records = [record("warcinfo", 0, b"x"), record("response", 1, http(1)), record("request", 2, b"GET"), record("response", 3, http(3))]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc").write_bytes(b"".join(records)[:-30])
    (tmp_path / "d.warc").write_bytes(b"")
    found = warc.read_responses(spark, str(tmp_path))
    rows = found.collect()
    per = {x: [(r.uri, bytes(r.block)) for r in rows if r.path.endswith(x) and not r.error] for x in ("a.warc", "b.warc.gz", "c.warc")}
    assert per["a.warc"] == per["b.warc.gz"] == [("http://h/1", http(1)), ("http://h/3", http(3))] and per["c.warc"] == per["a.warc"][:1]
    assert [r.path[-6:] for r in rows if r.error] == ["c.warc"]
    out = warc.derivatives(found).where("record_type = 'conversion'").collect()
    assert sorted(bytes(r.block) for r in out) == [b"page 1", b"page 1", b"page 1", b"page 3", b"page 3"]
    assert all(b"WARC-Date: 2021-05-05T00:00:00Z" in bytes(r.record) for r in out)
