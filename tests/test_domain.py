"""Golden cases of the domain operators."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from procura.functions import amounts, constants, dates, text
from procura.operators import dedup, documents, items, pricing, requirements, risk, runs, search, upsert
from procura.sources import catalog, export, notices, registry
from procura.streaming import ingest


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


AMOUNTS = [
    ("1.234,50", 1234.5, 100), ("1,234.50", 1234.5, 100), ("1234.5", 1234.5, 100), ("1.234", 1234.0, 60), ("0.125", 125.0, 60), ("1.234.567", 1234567.0, 100),
    ("12 345,67 EUR", 12345.67, 100), ("12 345,67", 12345.67, 100), ("1'234.50", 1234.5, 100), ("99,-", 99.0, 100), ("-5,5", -5.5, 100), ("none", None, 0),
    ("ca. 15", 15.0, 100), ("", None, 0), ("12 5", 12.0, 100), ("3,", 3.0, 100), (None, None, 0), ("1,234,567.89", 1234567.89, 100),
]


def test_amounts(spark):
    got = each(spark, [a for a, *_ in AMOUNTS], amounts.amount)
    assert [(g["value"], g["confidence"]) for g in got] == [(v, c) for _, v, c in AMOUNTS]


def test_currency_rate_tiers(spark):
    assert each(spark, ["12 eur", "abc", "5 €", "x", None], amounts.currency) == ["EUR", "ABC", "EUR", None, None]
    assert each(spark, ["19", "19 %", "0,19", "-3", "1", None], amounts.rate) == [0.19, 0.19, 0.19, None, 1.0, None]
    got = each(spark, ["100:172,50|50:179,00", "x;5:1", None], amounts.tiers)
    assert [[tuple(t) for t in g] for g in got] == [[(50.0, 179.0), (100.0, 172.5)], [(5.0, 1.0)], []]
    row = spark.sql("SELECT array(named_struct('min_quantity', 50D, 'amount', 179D), named_struct('min_quantity', 100D, 'amount', 172.5D)) t")
    q = [row.select(amounts.amount_for(F.lit(189.0), F.col("t"), F.lit(x).cast("double"))).first()[0] for x in (10, 50, 120, None)]
    assert q == [189.0, 179.0, 172.5, 189.0]


def test_basis_and_availability(spark):
    assert each(spark, ["netto", "Brutto", "inkl. MwSt", "?", None], amounts.price_basis) == ["NET", "GROSS", "GROSS", "UNKNOWN", "UNKNOWN"]
    # D1: the longest word decides, umlauts count.
    assert each(spark, ["Lager", "nicht verfuegbar", "verfügbar", "Auf Bestellung", None], amounts.availability) == ["IN_STOCK", "UNAVAILABLE", "IN_STOCK", "ON_ORDER", "UNKNOWN"]


def test_normalisation(spark):
    assert each(spark, ["2.000 Monitore, Größe 1.234.567!", "Àéñ ﬁx", None, "  A–b  "], text.normalize_text) == ["2000 monitore groesse 1234567", "aen fix", "", "a b"]
    assert each(spark, ["MX-27", "mx 27", None], text.normalize_identifier) == ["mx27", "mx27", ""]
    assert each(spark, ["Monitoren", "Messer", "Stuhles", "und", "Lieferung von Monitoren"], text.tokens) == [["monitor"], ["messer"], ["stuhl"], [], ["von", "monitor"]]
    assert each(spark, ["<p>a &amp; b&nbsp;</p>", "<br>", None], text.strip_html) == ["a & b", None, None]
    assert each(spark, ["39130000-2 und 30231300", "1234567"], text.cpv_codes) == [["39130000", "30231300"], []]
    assert each(spark, [None, " ", "x"], text.display) == ["UNKNOWN", "UNKNOWN", "x"]
    assert each(spark, [1234.5], text.german_number, "double") == ["1.234,50"]


UNITS = [("Stk", "STK"), ("St.", "STK"), ("Stück", "STK"), ("m²", "M2"), ("lfm", "M"), ("Laufender Meter", "M"), ("100 Stk", "STK"), ("kg.", "KG"), ("%", "PCT"), ("Kiste", None), ("", None), (None, None)]


def test_units(spark):
    assert each(spark, [u for u, _ in UNITS], text.normalize_unit) == [c for _, c in UNITS]


def test_dates(spark):
    assert each(spark, ["2026-08-25+02:00", "20260825", "5.8.2026", "31.02.2026", "2026/8/5", "x", None], dates.parse_date) == [
        date(2026, 8, 25), date(2026, 8, 25), date(2026, 8, 5), None, date(2026, 8, 5), None, None]
    assert each(spark, ["2026-09-15T12:00:00+02:00", "15.9.2026", "?"], dates.parse_datetime) == [datetime(2026, 9, 15, 10), datetime(2026, 9, 15), None]
    assert each(spark, ["15.10.2036, 10:00 Uhr", "2036-10-15", "offen"], dates.local_deadline) == [datetime(2036, 10, 15, 8), datetime(2036, 10, 14, 22), None]
    found = each(spark, ["Angebotsfrist: 1.2.2036, Bindefrist bis 5.3.2036", "Frist 1.2.2036", "Lieferfrist am 9.9.2036"], dates.deadlines)
    assert [tuple(f) for f in found] == [(date(2036, 2, 1), date(2036, 3, 5), None), (None, None, None), (None, None, date(2036, 9, 9))]
    # 23:00 to 01:00 of the next day is no whole day.
    got = spark.sql("SELECT timestamp'2026-01-02 01:00:00' d, timestamp'2026-01-01 23:00:00' n").select(dates.days_until(F.col("d"), F.col("n")), dates.days_until(F.col("n"), F.col("d"))).first()
    assert tuple(got) == (0, -1)


SENTENCES = [
    ("Der Bieter legt ein Zertifikat nach DIN EN ISO 9001 vor.", "CERTIFICATION", "DIN EN ISO 9001"),
    ("Gefordert ist das Umweltzeichen Blauer Engel.", "CERTIFICATION", "Blauer Engel"),
    ("Es gilt ein Zahlungsziel von 60 Tagen.", "PAYMENT_TERMS", "60"),
    ("Geliefert wird an 12 verschiedene Standorte.", "DELIVERY_TERMS", "12"),
    ("Bei Verzug faellt eine Vertragsstrafe an.", "PENALTY", None),
    ("Eine Bürgschaft ist zu stellen.", "SECURITY", None),
    ("Fabrikat Muster oder gleichwertig ist anzubieten.", "BRAND_LOCK", None),
    ("Mindestens vier Referenzen sind noetig.", "ELIGIBILITY", None),
]


def test_requirements(spark):
    pages = spark.createDataFrame([(1, 0, 1, " ".join(s for s, *_ in SENTENCES) + " Eine Bürgschaft ist zu stellen."), (2, 0, 1, "Nichts von Belang steht hier.")], "tender_id int, doc int, page int, text string")
    found = requirements.find(pages).collect()
    got = {(r.evidence, r.kind): r.value for r in found}
    for s, kind, value in SENTENCES:
        assert (s, kind) in got and (value is None or got[s, kind] == value), s
    assert len([r for r in found if r.kind == "SECURITY"]) == 1
    many = spark.createDataFrame([(1, 0, 1, ". ".join(f"Vertragsstrafe Nummer {i} hier" for i in range(40)))], "tender_id int, doc int, page int, text string")
    assert requirements.find(many).count() == constants.FINDINGS_PER_KIND
    scope = {r.tender_id: r.scope for r in requirements.equivalence_scope(pages, requirements.find(pages)).collect()}
    assert scope == {1: "inline", 2: "none"}
    lists = requirements.requirement_lists(requirements.find(pages)).first()
    assert lists.certifications[:2] == ["DIN EN ISO 9001", "Blauer Engel"] and lists.payment_terms.startswith("Es gilt")


def test_risk(spark):
    cols = "tender_id int, deadline timestamp, estimated_value double, delivery_date date, n_documents int, n_unreadable int, n_readable int, n_chars int, scope string, penalty long, security long, brand_lock long, minimum long, award_criteria long, certificates long, payment_days int, sites int"
    as_of = datetime(2026, 1, 1)
    rows = [
        (1, datetime(2026, 1, 4), 5.0, date(2026, 1, 11), 1, 0, 1, 9000, "none", 1, 1, 1, 5, 1, 7, 60, 50),
        (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
        (3, datetime(2026, 3, 1), 5.0, None, 2, 1, 1, 100, "inline", 0, 0, 1, 0, 1, 2, 30, 4),
    ]
    got = {r.tender_id: r for r in risk.assess(spark.createDataFrame(rows, cols), F.lit(as_of)).collect()}
    codes = {t: {f.code: f.points for f in r.factors} for t, r in got.items()}
    assert codes[1] == {"deadline_very_tight": 25, "many_certifications": 20, "brand_lock_strict": 18, "contract_penalty": 15, "delivery_many_sites": 15, "delivery_lead_time_short": 15, "security_required": 12, "payment_terms_long": 10, "many_minimum_requirements": 8}
    assert got[1].score == 100 and got[1].level == "VERY_HIGH"
    assert codes[2] == {"deadline_unknown": 15, "value_unknown": 12, "documents_missing": 20} and got[2].level == "HIGH"
    assert codes[3] == {"documents_unreadable": 8, "content_thin": 10, "certifications_required": 5, "brand_lock_with_equivalence": 5}
    assert [f.points for f in got[1].factors] == sorted((f.points for f in got[1].factors), reverse=True)


def test_items_of_tables_and_text(spark):
    heads = spark.createDataFrame([("a", i, c) for i, c in enumerate(["Pos.", "Bezeichnung", "Menge", "ME", "Hersteller"])], "table_id string, idx int, cell string")
    cells = [
        ["1.10", "Bürostuhl drehbar\nFarbe: schwarz; Norm: EN 1335", "ca. 15", "Stk", "Muster GmbH"],
        ["1.9", "Schreibtisch", "auf Abruf", "Kiste", None],
        ["", "Zwischensumme", "3", "", ""],
        ["2", "Regal, Typ: R-7 oder gleichwertig", "1.234", "Stück", ""],
    ]
    rows = spark.createDataFrame([(1, "d", "a", i, c) for i, c in enumerate(cells)], "tender_id int, doc string, table_id string, row_no int, cells array<string>")
    got = {r.row_no: r for r in items.from_tables(rows, items.map_columns(heads)).collect()}
    assert set(got) == {0, 1, 3}
    chair, desk, shelf = got[0], got[1], got[3]
    assert (chair.title, chair.quantity, chair.estimated, chair.unit, chair.brand_locked) == ("Bürostuhl drehbar", 15.0, True, "STK", True)
    assert chair.specifications == {"Farbe": "schwarz", "Norm": "EN 1335"} and chair.confidence == 40 + 12 + 10 + 8 + 8 + 4 + 5
    assert desk.quantity is None and set(desk.warnings) == {"quantity is not fixed", "unit is unknown"} and desk.confidence == 40 + 3 + 8 + 5
    assert (shelf.quantity, shelf.estimated, shelf.model_number, shelf.brand_locked) == (1234.0, True, "R-7", False)
    page = "1.10  20 Stk Buerostuhl, drehbar\nPos. 2) Tisch, 15 Stueck, hoehenverstellbar\n3 ohne Menge hier\nSumme 4 Stk"
    pages = spark.createDataFrame([(1, "d", 1, page), (2, "e", 1, page)], "tender_id int, doc string, page int, text string")
    texts = items.from_text(pages)
    lines = {(r.tender_id, r.position): (r.title, r.quantity, r.unit) for r in texts.collect()}
    assert lines[2, "1.10"] == ("Buerostuhl, drehbar", 20.0, "STK") and lines[2, "2"] == ("Tisch, hoehenverstellbar", 15.0, "STK") and len(lines) == 4
    both = items.with_fallback(items.from_tables(rows, items.map_columns(heads)), texts)
    assert {r.tender_id for r in both.where("confidence > 0").collect()} == {1, 2} and both.count() == 5
    ranked = items.natural_rank(both, "row_no").where("tender_id = 1").orderBy("ordinal").collect()
    assert [r.position for r in ranked] == ["1.9", "1.10", "2"]


def test_quantity(spark):
    got = each(spark, ["ca. 15", "auf Abruf", "-3", "1.234", "x", None, "20"], items.quantity)
    assert [(g.value, g.estimated) for g in got] == [(15.0, True), (None, False), (None, False), (1234.0, True), (None, False), (None, False), (20.0, False)]


def test_match_ladder(spark):
    item = [
        (1, "Monitor 27 Zoll", "Muster GmbH", "MX-27", "A-1", "STK", False), (2, "Monitor 27 Zoll", "Muster GmbH", "MX-27", None, "STK", True),
        (3, "Monitor 27 Zoll", None, None, None, "STK", False), (4, "Lieferung von Monitoren", None, None, None, "M", False), (5, "Stuhl", None, None, None, None, False),
    ]
    quote = [
        ("q1", "Monitor 27 Zoll", "MUSTER GmbH", "mx 27", "a1", 189.0, "EUR", "NET", None, "STK"), ("q2", "Monitor 27 Zoll", "Andere AG", "MX-27", None, 150.0, "EUR", "UNKNOWN", None, "STK"),
    ]
    i = spark.createDataFrame(item, "item_id int, title string, manufacturer string, model_number string, article_number string, unit string, brand_locked boolean")
    q = spark.createDataFrame(quote, "quote_id string, product_name string, manufacturer string, model_number string, article_number string, amount double, currency string, basis string, vat_rate double, q_unit string")
    pairs = pricing.candidates(i, q).join(pricing.with_item_keys(i).drop("article_number", "model_number", "manufacturer"), "item_id")
    s = pricing.score(pairs.join(pricing.with_quote_keys(q).drop("article_number", "model_number", "manufacturer"), "quote_id"))
    got = {(r.item_id, r.quote_id): r.score for r in s.collect()}
    assert got == {(1, "q1"): 95, (1, "q2"): 70, (2, "q1"): 90, (2, "q2"): 20, (3, "q1"): 75, (3, "q2"): 75, (4, "q1"): 30, (4, "q2"): 30}
    concerns = {(r.item_id, r.quote_id): r.concerns for r in s.collect()}
    assert "brand lock not met" in concerns[2, "q2"] and "unit differs" in concerns[4, "q1"] and "price basis unknown" in concerns[1, "q2"]
    ranked = pricing.rank(s).withColumn("net", amounts.net_amount(F.col("amount"), F.col("basis"), F.col("vat_rate"))["net"])
    stats = {r.item_id: r for r in pricing.price_statistics(ranked).collect()}
    assert stats[1].usable_count == 1 and stats[1].warnings == ["single offer"] and stats[3].warnings == ["best offer is under the least score"]
    # Zero sorts last among offers but is the best price of equal ones.
    zero = spark.createDataFrame([(1, "a", 75, 0.0), (1, "b", 75, 5.0), (1, "c", 75, None)], "item_id int, quote_id string, score int, amount double")
    r = pricing.rank(zero)
    assert [x.quote_id for x in r.orderBy("rank").collect()] == ["b", "a", "c"] and pricing.best_match(r).first().quote_id == "a"


def test_leading_currency(spark):
    rows = [(1, 1, 90, 10.0, "usd"), (1, 2, 90, 20.0, "EUR"), (1, 3, 90, 30.0, "EUR"), (1, 4, 90, None, "EUR"), (2, 1, 90, 1.0, "USD"), (2, 2, 90, 9.0, "EUR"), (3, 1, 10, 5.0, "EUR")]
    df = spark.createDataFrame(rows, "item_id int, rank int, score int, net double, currency string")
    got = {r.item_id: (r.currency, r.usable_count, r.minimum, r.median) for r in pricing.price_statistics(df).collect()}
    assert got == {1: ("EUR", 2, 20.0, 25.0), 2: ("USD", 1, 1.0, 1.0), 3: (None, 0, None, None)}


def notice_rows(spark, rows):
    cols = "id string, source string, title string, authority string, national_id string, publication_date date, deadline timestamp, first_seen timestamp, last_seen_at timestamp"
    return dedup.with_keys(spark.createDataFrame(rows, cols))


def test_duplicates(spark):
    t, d = datetime(2036, 9, 1), date(2026, 8, 1)
    store = notice_rows(spark, [
        ("a:1", "a", "Lieferung von Monitoren fuer die Verwaltung", "Stadt Muster", "N-1", d, t, t, t),
        ("a:2", "a", "Reinigung der Schulen im Norden", "Stadt Beispiel", None, d, t, t, t),
        ("a:3", "a", "Neubau einer Turnhalle am Park", "Gemeinde Drei", None, date(2026, 1, 1), t, t, t),
    ])
    new = notice_rows(spark, [
        ("b:1", "b", "ganz anders", "x", "N-1", d, t, t, t),
        ("b:2", "b", "Reinigung der Schulen im Norden", "Stadt Beispiel", None, d, t, t, t),
        ("b:3", "b", "Lieferung von Monitoren fuer die Verwaltungen", "Stadt Muster", None, d, datetime(2036, 9, 2), t, t),
        ("b:4", "b", "Neubau einer Turnhalle am Parks", "Gemeinde Drei", None, d, datetime(2036, 9, 9), t, t),
        ("b:5", "b", "Strassenbau", "Stadt Muster", None, d, t, t, t),
        ("a:9", "a", "Reinigung der Schulen im Norden", "Stadt Beispiel", None, d, t, t, t),
    ])
    got = {r.id: (r.candidate, r.reason) for r in dedup.find_duplicates(new, store).collect()}
    assert got == {"b:1": ("a:1", "national_id"), "b:2": ("a:2", "fingerprint"), "b:3": ("a:1", "title_similarity")}


def test_duplicate_recall_past_the_authority_limit(spark):
    t = datetime(2036, 9, 1)
    filler = [(f"a:{i}", "a", f"Lieferung von Geraeten Nr {i} fuer Verwaltung {i % 37}", "Stadt 1", None, date(2026, 8, 1), t, t, t) for i in range(601)]
    new = [("b:0", "b", filler[0][2], "Stadt 1", None, date(2026, 8, 2), datetime(2036, 9, 5), t, t)]
    got = dedup.find_duplicates(notice_rows(spark, new), notice_rows(spark, filler)).collect()
    assert [(r.id, r.candidate, r.confidence) for r in got] == [("b:0", "a:0", 100)]


def test_election_and_upsert(spark):
    m = spark.createDataFrame([("g", "x", 50, 1), ("g", "y", 10, 2), ("g", "z", 10, 3)], "group string, id string, priority int, arrival int")
    assert {r.primary_id for r in dedup.elect_primary(m).collect()} == {"y"}
    old = spark.createDataFrame([(1, "a", "n1", "h1"), (2, "b", "n2", "h2"), (3, "c", None, "h3")], "id int, title string, national_id string, content_hash string").withColumn("source", F.lit("s"))
    new = spark.createDataFrame([(1, "a", "n1", "h1"), (2, "B", None, "h9"), (4, "d", None, "h4"), (5, "e", None, "h5")], "id int, title string, national_id string, content_hash string").withColumn("source", F.lit("s"))
    acts = {r.id: r.action for r in upsert.verdicts(new, old, spark.createDataFrame([(5,)], "id int")).collect()}
    assert acts == {1: "unchanged", 2: "updated", 4: "new", 5: "duplicate"}
    merged = {r.id: (r.title, r.national_id) for r in upsert.merge(new, old, ["title", "national_id"], ("national_id",)).collect()}
    assert merged == {1: ("a", "n1"), 2: ("B", "n2"), 3: ("c", None), 4: ("d", None), 5: ("e", None)}
    log = {(r.id, r.field): (r.old_value, r.new_value) for r in upsert.change_log(new, old, {"title": None, "national_id": F.lit("(changed)")}).collect()}
    assert log == {(2, "title"): ("b", "B"), (2, "national_id"): ("(changed)", "(changed)")}


def test_source_state_and_budget(spark):
    rows = [("a", 1, 1, False), ("a", 2, 2, True), ("a", 3, 3, False), ("a", 4, 4, False), ("b", 1, 5, False), ("c", 1, 6, True)]
    got = {r.source: r.consecutive_failures for r in runs.source_state(spark.createDataFrame(rows, "source string, ts int, run_id int, ok boolean")).collect()}
    assert got == {"a": 2, "b": 1, "c": 0}
    pages = spark.createDataFrame([("d", 1, "abcd"), ("d", 2, "efgh"), ("d", 3, "x")], "doc string, page int, text string")
    assert [(r.text, r.truncated) for r in runs.character_budget(pages, 6).orderBy("page").collect()] == [("abcd", False), ("ef", True)]


def test_tolerant_search(spark):
    rows = [(1, "Monitor", None, None, None, None), (2, "Stuhl", "DEU", ["30231300"], date(2026, 1, 1), None), (3, None, "fra", ["39000000"], None, None)]
    df = spark.createDataFrame(rows, "id int, title string, country string, cpv_codes array<string>, publication_date date, deadline timestamp").withColumns({"description": F.lit(None).cast("string"), "authority": F.lit(None).cast("string")})
    ids = lambda q: [r.id for r in search.search(df, q).orderBy("id").collect()]
    assert ids(search.Query(countries=("deu",))) == [1, 2]
    assert ids(search.Query(cpv_codes=("30200000",))) == [1, 2]
    assert ids(search.Query(cpv_codes=("39130000",))) == [1, 3]
    assert ids(search.Query(keywords=("MONITOR",))) == [1] and ids(search.Query(keywords=("",))) == [1, 2]
    assert ids(search.Query(published_after=date(2026, 2, 1))) == [1, 3]


def test_html_documents(spark):
    page = "<html><head><title>T</title><style>x</style></head><body><nav><table><tr><th>Pos</th><th>Text</th></tr><tr><td>1</td><td>a &amp; b</td></tr></table>menu</nav><p>Hello <b>you</b></p><script>no</script></body></html>"
    files = spark.createDataFrame([(1, page.encode(), "text/html; charset=utf-8", ""), (2, None, None, ".txt"), (3, b"x", None, ".pdf"), (4, b"  ", None, ".txt"), (5, b"PK broken", None, ".docx"), (6, b"a;b\n1;2\n", None, ".csv")], "doc int, content binary, media_type string, suffix string")
    got = {r.doc: r for r in documents.extract_documents(files).collect()}
    assert {d: r.status for d, r in got.items()} == {1: "OK", 2: "FAILED", 3: "UNSUPPORTED", 4: "EMPTY", 5: "FAILED", 6: "OK"}
    assert got[1].title == "T" and got[1].tables[0].header == ["Pos", "Text"] and got[1].tables[0].rows == [["1", "a & b"]]
    assert got[1].pages[0].text == "T\nHello\nyou" and got[6].tables[0].header == ["a", "b"]
    assert tuple(documents.document_report(documents.extract_documents(files)).first()) == (6, 2, 3)
    assert documents.extract(b"abcdef", "text/plain", "", 3)["status"] == "PARTIAL"


def test_exports_and_workbooks(spark, tmp_path):
    df = spark.createDataFrame([("a:1", "Größe", 1.5), ("a:2", None, None)], "id string, title string, value double")
    assert export.write_file(df, str(tmp_path / "x.csv"), "csv") == 2
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfid;title;value\r\na:1;Gr")
    export.write_file(df, str(tmp_path / "x.json"), "json")
    assert json.loads((tmp_path / "x.json").read_text())["count"] == 2
    export.write_file(df, str(tmp_path / "x.xlsx"), "xlsx")
    assert list(documents.sheets((tmp_path / "x.xlsx").read_bytes())) == [("Export", [["id", "title", "value"], ["a:1", "Größe", "1.5"], ["a:2", "", ""]])]
    with pytest.raises(ValueError):
        export.write_file(df, "x", "pdf")
    with pytest.raises(ValueError):
        export.write_file(df, str(tmp_path / "y.csv"), "csv", most=1)


def test_notice_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"tenders": [{"source_id": "d1", "title": "Monitore", "country": "DEU", "cpv_codes": ["30231300", " "], "publication_date": "2026-08-25", "submission_deadline": "2026-09-15T12:00:00+02:00"}, {"id": "d2", "title": "B"}]}))
    got = {r.id: r for r in notices.read_list(spark, str(tmp_path / "l.json")).collect()}
    assert set(got) == {"fixture:d1", "fixture:d2"} and got["fixture:d1"].deadline == datetime(2026, 9, 15, 10) and got["fixture:d1"].cpv_codes == ["30231300"]
    (tmp_path / "bare.json").write_text(json.dumps([{"title": "x"}]))
    assert [r.source_id for r in notices.read_list(spark, str(tmp_path / "bare.json")).collect()] == ["0"]
    one = {"publication-number": "77-2026", "notice-title": {"eng": ["Desks"], "deu": [" ", "Tische"]}, "buyer-name": {"fra": ["Ville"]}, "notice-type": "cn-standard", "publication-date": "2026-08-25+02:00", "deadline-receipt-request": "2026-09-01T00:00:00Z", "total-value": {"amount": 5.5, "currency": "eur"}, "links": {"pdf": {"DEU": "http://x/p.pdf"}}}
    (tmp_path / "api.json").write_text(json.dumps({"results": [one, one, {"notice-type": "x"}]}))
    api = notices.read_api(spark, str(tmp_path / "api.json"), F.lit(datetime(2026, 12, 1))).collect()
    assert len(api) == 1 and (api[0].title, api[0].authority, api[0].status, api[0].currency, api[0].documents[0].url) == ("Tische", "Ville", "CLOSED", "EUR", "http://x/p.pdf")
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="no list"):
        notices.read_api(spark, str(tmp_path / "bad.json"), F.lit(datetime(2026, 12, 1))).collect()
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Bau &amp; mehr</title><link>http://x/1</link><guid>g1</guid><description>&lt;p&gt;Angebotsfrist: 1.2.2036&lt;/p&gt;</description><pubDate>Mon, 24 Aug 2026 10:00:00 GMT</pubDate></item></channel></rss>")
    (tmp_path / "evil.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><rss><item><title>t</title></item></rss>')
    feed = notices.read_feed(spark, str(tmp_path / "*.xml")).collect()
    assert len(feed) == 1 and (feed[0].title, feed[0].publication_date, feed[0].deadline) == ("Bau & mehr", date(2026, 8, 24), datetime(2036, 2, 1))
    built = registry.build(spark, [registry.Source("b", "list", str(tmp_path / "l.json"), 20), registry.Source("z", "nope", ""), registry.Source("a", "feed", str(tmp_path / "f.xml"), 10), registry.Source("off", "list", "", enabled=False)])
    assert [s.name for s, _ in built] == ["a", "b"]


def test_values_of_any_shape(spark, tmp_path):
    shapes = ["Tisch", ["Tisch", "Stuhl"], {"deu": "Tisch"}, {"eng": ["Desk"], "deu": ["Tisch"]}, {"xx": [" ", "Tisch"]}]
    money = [{"amount": 5.5, "currency": "eur"}, 5.5, "5,50 EUR", [{"value": "5.5", "currency": "EUR"}], "5.5"]
    rows = [{"publication-number": str(i), "notice-title": x, "buyer-name": x, "total-value": m, "classification-cpv": "30231300" if i else ["30231300"]} for i, (x, m) in enumerate(zip(shapes, money))]
    (tmp_path / "a.json").write_text(json.dumps({"notices": rows}))
    (tmp_path / "b.json").write_text(json.dumps({"data": [rows[0] | {"notice-title": "later"}]}))
    got = notices.read_api(spark, str(tmp_path / "*.json"), F.lit(datetime(2026, 12, 1))).collect()
    assert len(got) == 5 and all((r.title, r.authority, r.estimated_value, r.cpv_codes) == ("Tisch", "Tisch", 5.5, ["30231300"]) for r in got)
    assert {r.currency for r in got} == {"EUR", None}


def test_feeds_and_lists_of_several_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title>Bau</title><link rel="self" href="http://s"/><link href="http://x/1"/><id>e1</id><summary>kurz</summary><updated>2026-08-24T10:00:00Z</updated></entry></feed>')
    (tmp_path / "l.xml").write_bytes('<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><title>Möbel</title><link>http://x/2</link></item></channel></rss>'.encode("latin-1"))
    (tmp_path / "evil.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><rss><item><title>t</title></item></rss>')
    (tmp_path / "no.xml").write_text("<html></html>")
    got = {r.title: (r.source_url, r.description, r.publication_date) for r in notices.read_feed(spark, str(tmp_path / "*.xml")).collect()}
    assert got == {"Bau": ("http://x/1", "kurz", date(2026, 8, 24)), "Möbel": ("http://x/2", None, None)}
    failed = {r.path[-6:]: r.error for r in notices.feed_failures(spark, str(tmp_path / "*.xml")).collect()}
    assert failed == {"il.xml": "the feed declares a document type", "no.xml": "the file is no feed"}
    for i in (1, 2):
        (tmp_path / f"n{i}.json").write_text(json.dumps([{"title": f"t{i}", "lots": ["a"], "delivery_location": "here"}]))
        (tmp_path / f"p{i}.json").write_text(json.dumps([{"Bezeichnung": f"x{i}", "Preis": i}]))
        (tmp_path / f"p{i}.csv").write_text(f'Bezeichnung{",;"[i - 1]}Preis\n"x\n{i}"{",;"[i - 1]}{i}\n')
    rows = notices.read_list(spark, str(tmp_path / "n*.json")).collect()
    assert {r.id: (r.title, r.lots, r.delivery_location) for r in rows} == {"fixture:0@n1.json": ("t1", ["a"], "here"), "fixture:0@n2.json": ("t2", ["a"], "here")}
    assert sorted(map(tuple, catalog.load_rows(spark, str(tmp_path / "p*.json")).collect())) == [("x1", "1"), ("x2", "2")]
    assert sorted(map(tuple, catalog.load_rows(spark, str(tmp_path / "p*.csv")).collect())) == [("x\n1", "1"), ("x\n2", "2")]
    built = registry.build(spark, [registry.Source("gone", "list", str(tmp_path / "gone.json"), 1), registry.Source("bad", "api", str(tmp_path / "n1.json"), 2, options={"as_of": F.lit(datetime(2026, 1, 1))}), registry.Source("ok", "list", str(tmp_path / "n1.json"), 3)])
    assert [s.name for s, _ in built] == ["ok"]


def test_status_and_expert_query(spark):
    rows = [("cn-standard", 5), ("cn-standard", -5), ("can-x", -5), ("corr", None), ("other", 5), ("other", -5), (None, None)]
    df = spark.createDataFrame([(i, k, None if d is None else datetime(2026, 1, 10 + d)) for i, (k, d) in enumerate(rows)], "i int, k string, d timestamp")
    got = [r[0] for r in df.orderBy("i").select(notices.status_of(F.col("k"), F.col("d"), F.lit(datetime(2026, 1, 10)))).collect()]
    assert got == ["OPEN", "CLOSED", "AWARDED", "AMENDED", "OPEN", "CLOSED", "UNKNOWN"]
    q = search.Query(keywords=("a", "b"), countries=("deu",), published_after=date(2026, 1, 2))
    assert notices.expert_query(q, {"fulltext": "FT", "country": "CY", "publication_date": "PD"}, "20260101") == '(FT ~ ("a") OR FT ~ ("b")) AND CY IN (DEU) AND PD >= 20260102'


def test_html_list(spark):
    html = """<table id="r" class="big list"><tr><th>Titel</th></tr><tr class="hit"><td><a href="detail.do?id=4711">Stuehle</a></td><td>Stadt A</td><td>15.10.2036, 10:00 Uhr</td><td>39130000-2</td><td>180.000,00 EUR</td></tr>
    <tr class="hit"><td><a href="detail.do?id=4712">Tische</a></td><td>Stadt B</td><td>offen</td><td></td><td></td></tr></table>"""
    f = {"title": notices.Selector("td a"), "detail_url": notices.Selector("td a", "href"), "contracting_authority": notices.Selector("td:nth-of-type(2)"), "submission_deadline": notices.Selector("td:nth-of-type(3)"), "cpv_codes": notices.Selector("td:nth-of-type(4)"), "estimated_value": notices.Selector("td", index=4)}
    files = spark.createDataFrame([("p", html), ("q", None)], "path string, html string")
    rows = notices.html_rows(files, "table.list tr", f)
    got = {r.source_id: r for r in notices.notices_of_rows(rows, "portal", "https://x.invalid", "id").collect()}
    assert set(got) == {"4711", "4712"}
    a, b = got["4711"], got["4712"]
    assert (a.title, a.deadline, a.cpv_codes, a.estimated_value, a.currency, a.source_url) == ("Stuehle", datetime(2036, 10, 15, 8), ["39130000"], 180000.0, "EUR", "https://x.invalid/detail.do?id=4711")
    assert b.deadline is None and b.notes == ["deadline unreadable: offen"]
    more = spark.createDataFrame([("portal:4712", "text", "other")], "id string, description string, title string")
    filled = {r.source_id: r for r in notices.enrich(notices.notices_of_rows(rows, "portal", "https://x.invalid", "id"), more, ("description", "title")).collect()}
    assert (filled["4712"].description, filled["4712"].title, filled["4711"].description) == ("text", "Tische", None)


def test_catalogs(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Artikelnummer;BEZEICHNUNG ;Preis;Preisbasis;MwSt;Einheit;Staffelpreise;Verfuegbarkeit\nMX27;Monitor;189,00;netto;19;Stk;50:179,00|100:172,50;Lager\n;;5;;;;;\nX;Stuhl;;;;;;\n", encoding="utf-8")
    q = {r.product_name: r for r in catalog.quotes(catalog.load_rows(spark, str(tmp_path / "p.csv")), "shop", currency="EUR").collect()}
    assert set(q) == {"Monitor", "Stuhl"}
    m = q["Monitor"]
    assert (m.amount, m.currency, m.basis, m.vat_rate, m.unit, m.availability, m.supplier, len(m.tiers)) == (189.0, "EUR", "NET", 0.19, "STK", "IN_STOCK", "shop", 2)
    assert q["Stuhl"].warnings == ["price is missing", "price basis is missing"]
    (tmp_path / "p.json").write_text(json.dumps({"products": [{"Bezeichnung": "Monitor", "Preis": 5}]}))
    assert catalog.quotes(catalog.load_rows(spark, str(tmp_path / "p.json")), "j").first().amount == 5.0
    export.write_file(spark.createDataFrame([("Lampe", "7,5")], "Bezeichnung string, Preis string"), str(tmp_path / "p.xlsx"), "xlsx")
    assert catalog.quotes(catalog.load_rows(spark, str(tmp_path / "p.xlsx")), "x").first().amount == 7.5


def test_streaming_ingest(spark, tmp_path):
    schema = "id int, title string, national_id string, last_seen_at timestamp"
    inbox, store, cp = (str(tmp_path / x) for x in ("in", "store", "cp"))
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    put([(1, "a", "n1", datetime(2026, 1, 1)), (1, "old", None, datetime(2025, 1, 1)), (2, "b", None, datetime(2026, 1, 1))])
    ingest.run_available(spark, inbox, schema, store, cp).awaitTermination()
    put([(1, "A", None, datetime(2026, 2, 1)), (3, "c", None, datetime(2026, 2, 1))])
    ingest.run_available(spark, inbox, schema, store, cp).awaitTermination()
    ingest.run_available(spark, inbox, schema, store, cp).awaitTermination()
    got = {r.id: (r.title, r.national_id) for r in spark.read.parquet(f"{store}/version=1").collect()}
    assert got == {1: ("A", "n1"), 2: ("b", None), 3: ("c", None)}
