"""The ingest of a run: verdicts, change log, aliases, re-parenting, failures."""

from datetime import date, datetime

from pyspark.sql import functions as F

from procura.operators import ingest
from procura.sources.notices import COLUMNS

SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ", last_seen_at timestamp"
T = datetime(2026, 9, 1)


def notices(spark, rows):
    names = [*COLUMNS, "last_seen_at"]
    base = {"publication_date": date(2026, 8, 1), "deadline": datetime(2036, 9, 1), "status": "OPEN", "last_seen_at": T}
    made = [base | {"id": f"{r['source']}:{r['source_id']}"} | r for r in rows]
    return spark.createDataFrame([tuple(m.get(n) for n in names) for m in made], SCHEMA)


def empty_store(spark):
    return spark.createDataFrame([], SCHEMA + ", first_seen timestamp, content_hash string, primary_id string, is_primary boolean")


def n(source, no, title, **more):
    return {"source": source, "source_id": str(no), "title": title, "authority": "Stadt Muster", **more}


def test_fold_of_sources(spark, tmp_path):
    b = notices(spark, [n("b", 1, "Lieferung von Monitoren"), n("b", 2, "Reinigung der Schulen")])
    c = notices(spark, [n("c", 1, "Lieferung von Monitoren", source_url="http://c/1"), n("c", 2, "Neubau einer Halle")])
    a = notices(spark, [n("a", 1, "Lieferung von Monitoren"), n("a", 2, "Strassenbau im Norden")])

    def broken():
        raise OSError("gone")

    first = ingest.run(spark, [("c", 50, lambda: c), ("b", 20, lambda: b), ("x", 30, broken)], empty_store(spark), str(tmp_path / "one"))
    assert {(r.id, r.action) for r in first.actions.collect()} == {("b:1", "new"), ("b:2", "new"), ("c:1", "duplicate"), ("c:2", "new")}
    assert [(r.tender_id, r.source, r.source_id, r.source_url, r.reason, r.confidence) for r in first.aliases.collect()] == [("b:1", "c", "1", "http://c/1", "fingerprint", 98)]
    primary = {r.id: (r.primary_id, r.is_primary) for r in first.store.collect()}
    assert primary == {"b:1": (None, True), "b:2": (None, True), "c:1": ("b:1", False), "c:2": (None, True)}
    report = {r.source: (r.n_found, r.n_new, r.n_duplicate, r.error) for r in first.report().collect()}
    assert report["c"] == (2, 1, 1, None) and report[None] == (4, 3, 1, None) and report["x"][0] is None and "gone" in report["x"][3]

    # A source of better priority takes the group over, children and all.
    second = ingest.run(spark, [("a", 10, lambda: a), ("b", 20, lambda: b), ("c", 50, lambda: c)], first.store, str(tmp_path / "two"))
    primary = {r.id: (r.primary_id, r.is_primary) for r in second.store.collect()}
    assert primary["a:1"] == ("a:1", True) and primary["b:1"] == primary["c:1"] == ("a:1", False) and primary["a:2"] == (None, True)
    assert [(r.tender_id, r.source, r.source_id) for r in second.aliases.collect()] == [("a:1", "b", "1")]
    assert {(r.id, r.action) for r in second.actions.collect()} >= {("b:1", "unchanged"), ("c:2", "unchanged"), ("a:1", "duplicate")}
    again = ingest.run(spark, [], second.store, str(tmp_path / "three"))
    assert again.actions.count() == 0 and again.store.count() == 6


def test_changes_and_content_hash(spark, tmp_path):
    priorities = spark.createDataFrame([("b", 10)], "source string, priority int")
    apply = lambda rows, store, to: ingest.apply_batch(notices(spark, rows), store, 10, priorities, ingest.writer(spark, str(tmp_path / to)))
    doc = lambda *urls: [(None, u, None, None) for u in urls]
    base = n("b", 1, "Titel", description="alt", cpv_codes=["2", "1"], documents=doc("u1", "u2"), estimated_value=5.0, national_id="N1")
    same = base | {"title": "TITEL ", "cpv_codes": ["1", "2"], "documents": doc("u2", "u1"), "description": "alt"}
    long = base | {"description": "x" * 2000}
    hashes = lambda *rows: [r.h for r in notices(spark, list(rows)).select(ingest.notice_hash().alias("h")).collect()]
    h = hashes(base, same, base | {"lots": ["l"]}, base | {"documents": doc("u1")}, base | {"status": "CLOSED"}, long, long | {"description": "x" * 2000 + "y"})
    assert h[0] == h[1] and len({h[0], *h[2:6]}) == 5 and h[5] == h[6]
    store = ingest.writer(spark, str(tmp_path))(apply([base], empty_store(spark), "one")["store"], "store")
    fresh = base | {"description": "neu", "estimated_value": 6.0, "documents": doc("u1"), "national_id": None, "last_seen_at": datetime(2026, 9, 2)}
    step = apply([fresh], store, "two")
    got = {r.field: (r.old_value, r.new_value) for r in step["changes"].collect()}
    assert got == {"description": ("(changed)", "(changed)"), "estimated_value": ("5.0", "6.0"), "documents": ("2", "1"), "national_id": ("N1", None)}
    row = step["store"].first()
    assert (row.national_id, row.first_seen, row.last_seen_at, row.estimated_value) == ("N1", T, datetime(2026, 9, 2), 6.0)
    fetched = ingest.new_links(notices(spark, [base | {"documents": doc("u1", "u9")}]), store).collect()
    assert [(r.id, r.url) for r in fetched] == [("b:1", "u9")]
    # What is unchanged logs nothing, whatever its spelling.
    quiet = apply([same], store, "three")
    assert quiet["changes"].count() == 0 and quiet["actions"].first().action == "unchanged"
    assert quiet["store"].select(F.col("primary_id")).first()[0] is None
