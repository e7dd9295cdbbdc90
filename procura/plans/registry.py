"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from procura.functions import amounts, constants, dates, text
from procura.operators import dedup, documents, ingest, items, pricing, requirements, risk, runs, search, upsert
from procura.plans import views as V
from procura.plans.views import as_of, read

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
WITH = f"WITH {V.NOTICE}"


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- filters, listings ------------------------------------------------------------------------------------------------
_EXPORT = f"""SELECT id, coalesce(nullif(trim(title), ''), 'UNKNOWN') AS title, authority, country, status, publication_date::VARCHAR AS publication_date,
 coalesce(strftime(deadline, '%Y-%m-%d %H:%M'), 'UNKNOWN') AS deadline,
 coalesce(floor((epoch_us(deadline) - epoch_us(as_of)) / 86400e6)::BIGINT::VARCHAR, 'UNKNOWN') AS days_left,
 coalesce(estimated_value::DECIMAL(18,2)::VARCHAR, 'UNKNOWN') AS estimated_value, code AS cpv_codes"""


@query(f"{WITH} {_EXPORT} FROM (SELECT * FROM notice WHERE deadline IS NULL OR deadline >= as_of ORDER BY deadline NULLS LAST, id LIMIT 100)")
def q_list_open_by_deadline(spark, d):
    return search.export_rows(search.list_notices(V.notice(spark, d), as_of=as_of(), open_only=True, limit=100), as_of())


@query(f"{WITH} {_EXPORT} FROM notice")
def q_export_rows(spark, d):
    return search.export_rows(V.notice(spark, d), as_of())


@query(
    f"""{WITH} SELECT id, publication_date, deadline, country FROM notice WHERE upper(country) IN ('GERMANY', 'FRANCE', 'NATION_1', 'NATION_2', 'NATION_3')
 AND publication_date >= DATE '1996-01-01' AND publication_date <= DATE '1999-12-31' AND (deadline IS NULL OR deadline >= as_of)"""
)
def q_search_tolerant_filter(spark, d):
    q = search.Query(
        countries=("Germany", "France", "Nation_1", "nation_2", "NATION_3"), published_after=date(1996, 1, 1), published_before=date(1999, 12, 31), deadline_after=V.AS_OF
    )
    return search.search(V.notice(spark, d), q).select("id", "publication_date", "deadline", "country")


@query(f"SELECT doc_id FROM documents WHERE contains({V.sql_norm('text')}, 'license') OR contains({V.sql_norm('text')}, 'tion the')")
def q_keyword_search(spark, d):
    return read(spark, d, "documents").where(search.keyword_match(("License", "tion, the"), F.col("text"))).select("doc_id")


@query(
    """SELECT p_partkey FROM (SELECT p_partkey, rtrim(lpad(p_partkey::VARCHAR, 8, '0'), '0') AS c FROM part)
 WHERE starts_with(c, '0000012') OR starts_with('0000012', c) OR starts_with(c, '000019') OR starts_with('000019', c)"""
)
def q_code_prefix_match(spark, d):
    codes = F.array(F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return read(spark, d, "part").where(search.code_match(("00000120", "00001900"), codes)).select("p_partkey")


@query(f"{WITH} SELECT id, floor((epoch_us(deadline) - epoch_us(as_of)) / 86400e6)::BIGINT AS days_left, deadline < as_of AS expired FROM notice")
def q_days_until_deadline(spark, d):
    left = dates.days_until(F.col("deadline"), as_of())
    return V.notice(spark, d).select("id", left.alias("days_left"), (left < 0).alias("expired"))


@query(f"{WITH} SELECT id, source_id, title FROM (SELECT *, CASE WHEN id::VARCHAR = 'n77' THEN 0 WHEN source_id = 'n77' THEN 1 END AS r FROM notice) WHERE r IS NOT NULL ORDER BY r, id LIMIT 1")
def q_point_lookup(spark, d):
    return search.lookup(V.notice(spark, d), F.lit("n77")).select("id", "source_id", "title")


@query(
    f"""{WITH} SELECT id, title, authority, estimated_value FROM notice WHERE source IN ('src0', 'src2') AND status = 'OPEN'
 AND (lower(title) LIKE '%b_ild%' OR lower(authority) LIKE '%b_ild%') ORDER BY estimated_value DESC NULLS LAST, id LIMIT 50 OFFSET 50"""
)
def q_paged_list(spark, d):
    page = search.list_notices(V.notice(spark, d), as_of=as_of(), sources=("src0", "src2"), status="OPEN", text="b_ild", order="value", offset=50, limit=50)
    return page.select("id", "title", "authority", "estimated_value")


# --- aggregates -------------------------------------------------------------------------------------------------------
@query(
    f"""{WITH} SELECT source, count(*) AS by_source, (SELECT count(*) FROM notice) AS tenders_total, (SELECT count(*) FROM notice) AS tenders_primary,
 (SELECT count(*) FROM notice WHERE deadline IS NULL OR deadline >= as_of) AS tenders_open FROM notice GROUP BY source"""
)
def q_stats_overview(spark, d):
    return search.statistics(V.notice(spark, d), as_of())


_HASHED = ("deadline", "status", "estimated_value", "title")
_VERDICT = f"""{WITH}, {V.BATCH}, acts AS (SELECT b.id, b.source, CASE WHEN s.id IS NULL THEN 'new'
 WHEN b.deadline IS NOT DISTINCT FROM s.deadline AND b.status = s.status AND b.estimated_value IS NOT DISTINCT FROM s.estimated_value THEN 'unchanged'
 ELSE 'updated' END AS action FROM batch b LEFT JOIN notice s ON b.id = s.id)"""


def _hashed(df):
    return df.withColumn("content_hash", text.content_hash(*[F.col(c) for c in _HASHED]))


def _actions(spark, d):
    none = spark.createDataFrame([], "id long")
    return upsert.verdicts(_hashed(V.batch(spark, d)), _hashed(V.notice(spark, d)), none)


@query(f"{_VERDICT} SELECT id, source, action FROM acts")
def q_content_hash_changes(spark, d):
    return _actions(spark, d)


@query(
    f"""{_VERDICT} SELECT source, count(*) AS n_found, count(*) FILTER (action = 'new') AS n_new, count(*) FILTER (action = 'updated') AS n_updated,
 count(*) FILTER (action = 'unchanged') AS n_unchanged, count(*) FILTER (action = 'duplicate') AS n_duplicate FROM acts GROUP BY ROLLUP (source)"""
)
def q_ingest_report_rollup(spark, d):
    return upsert.ingest_report(_actions(spark, d))


@query(
    f"""{WITH}, {V.BATCH}, j AS (SELECT b.id, b.deadline AS bd, s.deadline AS sd, b.status AS bs, s.status AS ss, b.estimated_value AS bv, s.estimated_value AS sv
 FROM batch b JOIN notice s ON b.id = s.id)
 SELECT id, 'deadline' AS field, sd::VARCHAR AS old_value, bd::VARCHAR AS new_value FROM j WHERE bd IS DISTINCT FROM sd
 UNION ALL SELECT id, 'status', ss, bs FROM j WHERE bs IS DISTINCT FROM ss
 UNION ALL SELECT id, 'estimated_value', '(changed)', '(changed)' FROM j WHERE bv IS DISTINCT FROM sv"""
)
def q_change_log(spark, d):
    return upsert.change_log(V.batch(spark, d), V.notice(spark, d), {"deadline": None, "status": None, "estimated_value": F.lit("(changed)"), "title": None})


@query(
    f"""{WITH}, {V.BATCH} SELECT coalesce(b.id, s.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.deadline ELSE s.deadline END AS deadline,
 CASE WHEN b.id IS NOT NULL THEN b.status ELSE s.status END AS status, coalesce(b.estimated_value, s.estimated_value) AS estimated_value
 FROM batch b FULL JOIN notice s ON b.id = s.id"""
)
def q_upsert_merge(spark, d):
    return upsert.merge(V.batch(spark, d), V.notice(spark, d), ["deadline", "status", "estimated_value"], ("estimated_value",))


@query(f"{_VERDICT} SELECT id FROM acts WHERE action <> 'unchanged'")
def q_incremental_skip(spark, d):
    done = _hashed(V.notice(spark, d))
    return upsert.pending(_hashed(V.batch(spark, d)), done).select("id")


# --- text -------------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {V.sql_norm('text')} AS normalized FROM documents")
def q_normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query(f"{WITH} SELECT id, sha256({V.sql_norm('title')} || '|' || {V.sql_norm('authority')} || '|' || coalesce(strftime(deadline, '%Y-%m-%d'), '')) AS fingerprint FROM notice")
def q_fingerprint(spark, d):
    return dedup.with_keys(V.notice(spark, d)).select("id", "fingerprint")


@query(
    r"""SELECT doc_id, len(s)::BIGINT AS n_sentences, s[1] AS first_sentence FROM (SELECT doc_id, list_filter(list_transform(
 regexp_extract_all(text, '[^.!?;\n]+[.!?;]?'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 8) AS s FROM documents)"""
)
def q_sentences(spark, d):
    s = read(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


_STRIP = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _a, _b in constants.ENTITIES:
    _STRIP = f"replace({_STRIP}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, nullif(trim(regexp_replace({_STRIP}, '\\s+', ' ', 'g')), '') AS text FROM pages")
def q_strip_html(spark, d):
    return read(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_no,
 coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), left(sha256(url), 24)) AS source_id FROM pages"""
)
def q_html_links(spark, d):
    page = F.url_decode(F.expr("try_parse_url(url, 'QUERY', 'page')"))
    return read(spark, d, "pages").select(
        "page_id", F.expr("try_parse_url(url, 'HOST')").alias("host"), page.alias("page_no"), F.coalesce(page, F.substring(F.sha2("url", 256), 1, 24)).alias("source_id")
    )


@query()
def q_html_text(spark, d):
    return documents.html_documents(read(spark, d, "pages").select(F.col("page_id").alias("doc"), "html"))


_T = r"regexp_extract(raw, '-?\d[\d.,'' ]*', 0)"


@query(
    rf"""WITH raws AS (SELECT 'p' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN replace(p_retailprice::DECIMAL(12,2)::VARCHAR, '.', ',') || ' EUR'
  WHEN 1 THEN 'USD ' || p_retailprice::DECIMAL(12,2)::VARCHAR ELSE (p_partkey % 900 + 100) || '.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') END AS raw FROM part),
 t AS (SELECT id, raw, regexp_replace(trim({_T}), '[.,]+$', '') AS tok FROM raws),
 u AS (SELECT *, length(tok) - length(regexp_replace(tok, '[.,]', '', 'g')) AS seps, length(regexp_extract(tok, '[.,]([^.,]*)$', 1)) AS tail FROM t)
 SELECT id, raw, CASE WHEN seps = 1 AND tail = 3 THEN regexp_replace(tok, '[.,]', '', 'g')::DOUBLE ELSE replace(tok, ',', '.')::DOUBLE END AS value,
 CASE WHEN seps = 1 AND tail = 3 THEN 60 ELSE 100 END AS confidence, CASE WHEN raw LIKE '%EUR%' THEN 'EUR' WHEN raw LIKE '%USD%' THEN 'USD' END AS currency FROM u"""
)
def q_amount_parse(spark, d):
    p, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    raw = (
        F.when(p % 3 == 0, F.concat(F.replace(price, F.lit("."), F.lit(",")), F.lit(" EUR")))
        .when(p % 3 == 1, F.concat(F.lit("USD "), price))
        .otherwise(F.concat(p % 900 + 100, F.lit("."), F.lpad((p % 1000).cast("string"), 3, "0")))
    )
    rows = read(spark, d, "part").select(F.concat(F.lit("p"), p).alias("id"), raw.alias("raw"))
    a = amounts.amount(F.col("raw"))
    return rows.select("id", "raw", a["value"].alias("value"), a["confidence"].alias("confidence"), amounts.currency(F.col("raw")).alias("currency"))


@query(f"WITH {V.ITEM} SELECT tender_id, ord, unit_original, unit FROM item")
def q_unit_normalize(spark, d):
    return V.item(spark, d).select("tender_id", "ord", "unit_original", text.normalize_unit(F.col("unit_original")).alias("unit"))


# --- ingest ---------------------------------------------------------------------------------------------------------
@query(
    f"""{WITH}, k AS (SELECT id, source, source_id, priority, title || '|' || authority AS k FROM notice),
 b AS (SELECT * FROM k WHERE source = 'src1'), s AS (SELECT * FROM k WHERE source <> 'src1'),
 f AS (SELECT b.id, b.source_id, min(s.id) AS old FROM b JOIN s USING (k) GROUP BY b.id, b.source_id),
 l AS (SELECT f.*, s.source AS old_source, s.source_id AS old_source_id, CASE WHEN 20 < s.priority THEN min(f.id) OVER (PARTITION BY f.old) ELSE f.old END AS prim
   FROM f JOIN s ON s.id = f.old)
 SELECT prim AS tender_id, CASE WHEN id = prim THEN old_source ELSE 'src1' END AS source, CASE WHEN id = prim THEN old_source_id ELSE source_id END AS source_id,
  'fingerprint' AS reason, 98 AS confidence FROM l"""
)
def q_alias_edges(spark, d):
    rows = V.notice(spark, d).select(
        "id", "source", "source_id", "priority", F.concat_ws("|", "title", "authority").alias("k"), F.lit(0).alias("first_seen"),
        F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("long").alias("primary_id"),
    )
    batch, store = rows.where("source = 'src1'"), rows.where("source <> 'src1'")
    found = dedup.exact_matches(batch, store, "k", "fingerprint", 98)
    links = ingest.linked(found, store, 20, rows.select("source", "priority").distinct())
    return ingest.alias_edges(links, batch, store).drop("source_url")


# --- duplicates -------------------------------------------------------------------------------------------------------
@query("SELECT a.doc_id AS id, min(b.doc_id) AS candidate FROM documents a JOIN documents b ON a.text = b.text AND a.source <> b.source GROUP BY a.doc_id")
def q_dup_exact_key(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("number"), "source", F.lit(0).alias("first_seen"))
    return dedup.exact_matches(docs, docs, "number", "national_id", 100).select("id", "candidate")


@query(
    f"""WITH f AS (SELECT doc_id, source, sha256({V.sql_norm('text')} || '|' || {V.sql_norm('lang')} || '|') AS fp FROM documents)
 SELECT a.doc_id AS id, min(b.doc_id) AS candidate, 'fingerprint' AS reason, 98 AS confidence FROM f a JOIN f b ON a.fp = b.fp AND a.source <> b.source GROUP BY a.doc_id"""
)
def q_dup_fingerprint(spark, d):
    none = F.lit(None).cast("string")
    fp = text.fingerprint(none, F.col("text"), F.col("lang"), F.lit(None).cast("timestamp"))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", fp.alias("fingerprint"), F.lit(0).alias("first_seen"))
    return dedup.exact_matches(docs, docs, "fingerprint", "fingerprint", 98)


@query(
    f"""{WITH}, k AS (SELECT *, {V.sql_norm('title')} AS t, {V.sql_norm('authority')} AS a FROM notice),
 b AS (SELECT *, left(a, 24) || '|' || array_to_string(string_split(t, ' ')[1:3], ' ') AS bk FROM k),
 p AS (SELECT n.id, s.id AS candidate, CASE WHEN n.bk = s.bk THEN 0 ELSE 1 END AS grp, s.last_seen_at FROM b n JOIN b s ON n.a = s.a AND n.source <> s.source
  AND s.publication_date BETWEEN n.publication_date - 21 AND n.publication_date + 21)
 SELECT id, candidate, grp FROM (SELECT *, row_number() OVER (PARTITION BY id, grp ORDER BY last_seen_at DESC, candidate) AS r FROM p) WHERE grp = 0 OR r <= 200"""
)
def q_dup_blocked_candidates(spark, d):
    n = dedup.with_keys(V.notice(spark, d))
    return dedup.candidates(n, n).select("id", "candidate", "grp")


@query()
def q_dup_fuzzy_score(spark, d):
    n = dedup.with_keys(V.notice(spark, d))
    return dedup.fuzzy_matches(dedup.candidates(n, n))


@query()
def q_find_duplicates(spark, d):
    n = dedup.with_keys(V.notice(spark, d))
    return dedup.find_duplicates(n, n)


@query(
    """WITH m AS (SELECT md5(text) AS g, doc_id AS id, (doc_id % 4 + 1) * 10 AS priority FROM documents)
 SELECT id, priority, first_value(id) OVER w AS primary_id, id = first_value(id) OVER w AS is_primary FROM m WINDOW w AS (PARTITION BY g ORDER BY priority, id)"""
)
def q_primary_election(spark, d):
    m = read(spark, d, "documents").select(
        F.md5("text").alias("group"), F.col("doc_id").alias("id"), ((F.col("doc_id") % 4 + 1) * 10).alias("priority"), F.col("doc_id").alias("arrival")
    )
    return dedup.elect_primary(m).select("id", "priority", "primary_id", "is_primary")


# --- requirements and risk --------------------------------------------------------------------------------------------
#: Rules whose words occur in these documents; the domain's rules are the default.
RULES = (
    ("CERTIFICATION", r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)", "contact", 85, True),
    ("TECHNICAL", r"(licen[cs]e[a-z]*)", "licence", 75, True),
    ("PAYMENT_TERMS", r"([0-9]+)", "number", 60, True),
)
_FOUND = r"""
s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?;\n]+[.!?;]?'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
  lambda x: length(x) >= 8)) AS sentence, generate_subscripts(list_filter(list_transform(regexp_extract_all(text, '[^.!?;\n]+[.!?;]?'),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 8), 1) - 1 AS sentence_no FROM documents),
r(rule_no, kind, pattern, label, confidence) AS (VALUES (0, 'CERTIFICATION', '([A-Za-z0-9._]+@[A-Za-z0-9.]+)', 'contact', 85),
  (1, 'TECHNICAL', '(?i)(licen[cs]e[a-z]*)', 'licence', 75), (2, 'PAYMENT_TERMS', '([0-9]+)', 'number', 60)),
h AS (SELECT doc_id AS tender_id, kind, label, regexp_extract(sentence, pattern, 1) AS value, confidence, sentence, sentence_no, rule_no,
  row_number() OVER (PARTITION BY doc_id, kind, lower(sentence) ORDER BY sentence_no, rule_no) AS n1 FROM s, r WHERE regexp_matches(sentence, pattern)),
f AS (SELECT *, CASE WHEN length(sentence) <= 400 THEN sentence ELSE rtrim(left(sentence, 399)) || '…' END AS evidence FROM (SELECT *,
  row_number() OVER (PARTITION BY tender_id, kind ORDER BY sentence_no, rule_no) AS n2 FROM h WHERE n1 = 1) WHERE n2 <= 25)"""


def _pages(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("tender_id"), F.lit(0).alias("doc"), F.lit(1).alias("page"), "text")


def _findings(spark, d):
    return requirements.find(_pages(spark, d), RULES)


@query(f"WITH {_FOUND} SELECT tender_id, kind, label, value, confidence, evidence, sentence_no::INT AS sentence_no, rule_no FROM f")
def q_rule_findings(spark, d):
    return _findings(spark, d).select("tender_id", "kind", "label", "value", "confidence", "evidence", "sentence_no", "rule_no")


@query(
    f"""WITH {_FOUND}, c AS (SELECT tender_id, lower(value) AS k, min((sentence_no, value)) AS m FROM f WHERE kind = 'CERTIFICATION' GROUP BY ALL),
 cc AS (SELECT tender_id, array_to_string(list(m[2] ORDER BY m), ' ; ') AS certifications FROM c GROUP BY tender_id)
 SELECT f.tender_id, coalesce(array_to_string(list(evidence ORDER BY sentence_no) FILTER (kind = 'TECHNICAL'), ' ; '), '') AS technical,
 min_by(evidence, sentence_no) FILTER (kind = 'PAYMENT_TERMS') AS payment_terms, any_value(certifications) AS certifications FROM f LEFT JOIN cc USING (tender_id) GROUP BY f.tender_id"""
)
def q_requirement_lists(spark, d):
    r = requirements.requirement_lists(_findings(spark, d))
    return r.select("tender_id", F.array_join("technical", " ; ").alias("technical"), "payment_terms", F.array_join("certifications", " ; ").alias("certifications"))


@query(
    rf"""WITH {_FOUND}, i AS (SELECT tender_id, bool_and(regexp_matches(evidence, '(?i)version\s+[0-9]|work')) AS inline FROM f WHERE kind = 'TECHNICAL' GROUP BY 1)
 SELECT d.doc_id AS tender_id, CASE WHEN inline THEN 'inline' WHEN regexp_matches(text, '(?i)version\s+[0-9]|work') THEN 'document' ELSE 'none' END AS scope
 FROM documents d LEFT JOIN i ON d.doc_id = i.tender_id"""
)
def q_equivalence_scope(spark, d):
    return requirements.equivalence_scope(_pages(spark, d), _findings(spark, d), r"(?i)version\s+[0-9]|work", "TECHNICAL")


_RISK = f"""{WITH}, {_FOUND}, g AS (SELECT tender_id, count(*) FILTER (kind = 'AWARD_CRITERIA') AS award,
  count(DISTINCT lower(value)) FILTER (kind = 'CERTIFICATION') AS certs, max(CASE WHEN kind = 'PAYMENT_TERMS' AND regexp_full_match(value, '[0-9]+')
  THEN try_cast(value AS INT) END) AS pay FROM f GROUP BY tender_id),
 w AS (SELECT n.id, n.deadline, n.estimated_value, floor((epoch_us(deadline) - epoch_us(as_of)) / 86400e6) AS days, d.doc_id IS NOT NULL AS docs,
  length(d.text) AS chars, coalesce(certs, 0) AS certs, coalesce(pay, 0) AS pay FROM notice n LEFT JOIN documents d ON n.id = d.doc_id LEFT JOIN g ON n.id = g.tender_id),
 x AS (SELECT id, list_filter([CASE WHEN days < 0 THEN ('deadline_passed', 40, 0) END, CASE WHEN days >= 0 AND days < 7 THEN ('deadline_very_tight', 25, 1) END,
  CASE WHEN days >= 7 AND days < 14 THEN ('deadline_tight', 12, 2) END, CASE WHEN deadline IS NULL THEN ('deadline_unknown', 15, 3) END,
  CASE WHEN estimated_value IS NULL THEN ('value_unknown', 12, 4) END, CASE WHEN NOT docs THEN ('documents_missing', 20, 5) END,
  CASE WHEN docs AND chars < 1500 THEN ('content_thin', 10, 7) END, CASE WHEN certs >= 3 THEN ('many_certifications', least(certs * 4, 20)::INT, 10) END,
  CASE WHEN certs IN (1, 2) THEN ('certifications_required', 5, 11) END, CASE WHEN pay >= 45 THEN ('payment_terms_long', 10, 17) END,
  CASE WHEN docs THEN ('award_criteria_unclear', 8, 19) END], lambda f: f IS NOT NULL) AS fs FROM w)"""


def _assessed(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("t"), F.length("text").alias("n_chars"))
    counts = risk.finding_counts(_findings(spark, d)).withColumnRenamed("tender_id", "f")
    n = V.notice(spark, d)
    j = n.join(docs, n["id"] == docs["t"], "left").join(counts, n["id"] == counts["f"], "left")
    has = F.when(F.col("t").isNotNull(), 1).otherwise(0)
    wide = j.withColumns({"tender_id": F.col("id"), "n_documents": has, "n_readable": has, "n_unreadable": F.lit(0), "scope": F.lit("none"), "delivery_date": F.lit(None).cast("date")})
    return risk.assess(wide, as_of())


@query(f"{_RISK} SELECT id AS tender_id, unnest(fs)[1] AS code, unnest(fs)[2] AS points FROM x")
def q_risk_factors(spark, d):
    return _assessed(spark, d).select("tender_id", F.inline("factors"))


@query(
    f"""{_RISK}, sc AS (SELECT id, least(100, coalesce(list_sum(list_transform(fs, lambda f: f[2])), 0))::INT AS score, fs FROM x)
 SELECT id AS tender_id, score, CASE WHEN score >= 70 THEN 'VERY_HIGH' WHEN score >= 45 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level,
 coalesce(array_to_string(list_transform(list_sort(list_transform(fs, lambda f: (-f[2], f[3], f[1]))), lambda f: f[3]), ','), '') AS factors FROM sc"""
)
def q_risk_score(spark, d):
    names = F.array_join(F.transform("factors", lambda f: f["code"]), ",")
    return _assessed(spark, d).select("tender_id", "score", "level", names.alias("factors"))


@query(
    f"""{_RISK}, sc AS (SELECT least(100, coalesce(list_sum(list_transform(fs, lambda f: f[2])), 0))::INT AS score FROM x)
 SELECT CASE WHEN score >= 70 THEN 'VERY_HIGH' WHEN score >= 45 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level, count(*) AS n, max(score) AS highest FROM sc GROUP BY 1"""
)
def q_risk_levels(spark, d):
    return _assessed(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("highest"))


@query(f"WITH {_FOUND} SELECT kind, count(*) AS n FROM f GROUP BY kind")
def q_findings_by_kind(spark, d):
    return _findings(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT conv_id AS doc, turn AS page, text, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations)
 SELECT doc, page, left(text, least(2000 - (total - n), n)::BIGINT) AS text, n > 2000 - (total - n) AS truncated FROM t WHERE 2000 - (total - n) > 0"""
)
def q_char_budget(spark, d):
    return runs.character_budget(read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"), 2000)


# --- items ------------------------------------------------------------------------------------------------------------
_HEADS = ["Pos.", "Bezeichnung der Leistung", "Menge in Stück", "ME", "Hersteller", "Typ", "Art.-Nr.", "Einzelpreis (EUR)", "Gesamtpreis", "Bemerkung", "Fabrikat/Typ", "E.-Preis"]
_ROLES = ["POSITION", "DESCRIPTION", "QUANTITY", "UNIT", "MANUFACTURER", "MODEL", "ARTICLE_NUMBER", "UNIT_PRICE", "TOTAL_PRICE", None, "MODEL", "UNIT_PRICE"]


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{h}', {'NULL' if r is None else repr(r)})" for i, (h, r) in enumerate(zip(_HEADS, _ROLES)))
    + ") t(idx, cell, role)"
)
def q_header_roles(spark, d):
    heads = spark.createDataFrame(list(enumerate(_HEADS)), "idx int, cell string")
    return heads.select("idx", "cell", items.header_role(F.col("cell")).alias("role"))


@query(
    """SELECT l_returnflag || l_linestatus AS table_id, role, idx FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem),
 (VALUES ('POSITION', 0), ('UNIT', 2), ('QUANTITY', 1), ('DESCRIPTION', 3)) t(role, idx)"""
)
def q_infer_columns(spark, d):
    line = read(spark, d, "lineitem")
    cells = F.array(
        F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("decimal(8,1)").cast("string"), F.lit("Stk"), F.concat(F.lit("Artikel ohne Ziffern, Gruppe "), F.col("l_returnflag")),
        F.concat(F.col("l_extendedprice").cast("decimal(12,2)"), F.lit(" EUR")),
    )
    rows = line.select(F.concat("l_returnflag", "l_linestatus").alias("table_id"), F.posexplode(cells).alias("idx", "cell"))
    return items.infer_columns(rows).select("table_id", "role", "idx")


_CONF = """CASE WHEN quantity IS NULL THEN 0 WHEN estimated THEN 12 ELSE 20 END + CASE WHEN unit IS NOT NULL THEN 10 ELSE 3 END + 8 + 8
 + CASE WHEN length(title) >= 12 THEN 5 ELSE 0 END + 40"""


def _read_items(spark, d):
    unit = text.normalize_unit(F.col("unit_original"))
    i = V.item(spark, d).withColumn("unit", unit)
    none = F.lit(None).cast("string")
    score = items.confidence(F.lit(40), F.col("quantity"), F.col("estimated"), F.col("unit"), F.col("unit_original"), F.col("position"), F.col("manufacturer"), none, F.lit(0), F.col("title"))
    return i.withColumn("confidence", score)


@query(f"WITH {V.ITEM} SELECT tender_id, ord, position, least(95, {_CONF}) AS confidence FROM item")
def q_item_confidence(spark, d):
    return _read_items(spark, d).select("tender_id", "ord", "position", "confidence")


@query(
    f"""WITH {V.ITEM}, c AS (SELECT *, least(95, {_CONF}) AS confidence FROM item),
 k AS (SELECT tender_id, ord, title, quantity, confidence, min(ord) OVER w AS first_ord, count(*) OVER w AS n_merged,
  row_number() OVER (PARTITION BY tender_id, left({V.sql_norm('title')}, 80), quantity ORDER BY confidence DESC, ord) AS nth FROM c
  WINDOW w AS (PARTITION BY tender_id, left({V.sql_norm('title')}, 80), quantity))
 SELECT tender_id, min(ord) AS ord, min(title) AS title, min(quantity) AS quantity, min(confidence) AS confidence, min(first_ord) AS first_ord, min(n_merged) AS n_merged
 FROM k WHERE nth = 1 GROUP BY tender_id, {V.sql_norm('title')}, quantity"""
)
def q_item_dedup(spark, d):
    i = _read_items(spark, d).withColumn("position", F.lit(None).cast("string"))
    # Order lines of one number: the smaller of equal rows; rows equal in all columns stand for one.
    i = i.groupBy("tender_id", "ord", "title", "quantity", "confidence", "position").agg(F.count(F.lit(1)).alias("copies"))
    w = W.partitionBy("tender_id", F.substring(text.normalize_text(F.col("title")), 1, 80), "quantity")
    out = items.deduplicate(i.withColumn("n_merged_all", F.sum("copies").over(w)))
    return out.select("tender_id", "ord", "title", "quantity", "confidence", "first_ord", F.col("n_merged_all").alias("n_merged"))


@query(
    f"""WITH {V.ITEM}, c AS (SELECT *, least(95, {_CONF}) AS confidence FROM item)
 SELECT tender_id, count(*) AS n_items, count(*) FILTER (trim(title) <> '' AND quantity IS NOT NULL AND unit IS NOT NULL) AS n_priceable,
 round_even(avg(confidence), 0)::INT AS mean_confidence, bool_and(quantity IS NOT NULL) AS all_quantities FROM c GROUP BY tender_id"""
)
def q_item_run_summary(spark, d):
    return items.run_summary(_read_items(spark, d))


@query(
    f"""WITH {V.ITEM} SELECT tender_id, position, row_number() OVER (PARTITION BY tender_id ORDER BY list_transform(string_split(position, '.'), lambda x: x::INT),
 {V.sql_norm('title')}) AS ordinal FROM item"""
)
def q_natural_sort(spark, d):
    return items.natural_rank(V.item(spark, d)).select("tender_id", "position", F.col("ordinal").cast("long").alias("ordinal"))


# --- prices -----------------------------------------------------------------------------------------------------------
@query(f"WITH {V.QUOTE} SELECT partkey, suppkey, round(CASE basis WHEN 'NET' THEN amount WHEN 'GROSS' THEN amount / (1 + vat_rate) END, 6) AS net, CASE WHEN basis = 'UNKNOWN' THEN 'price basis unknown' WHEN basis = 'GROSS' AND vat_rate IS NULL THEN 'gross price without tax rate' END AS reason FROM quote")
def q_net_amount(spark, d):
    n = amounts.net_amount(F.col("amount"), F.col("basis"), F.col("vat_rate"))
    return V.quote(spark, d).select("partkey", "suppkey", F.round(n["net"], 6).alias("net"), n["reason"].alias("reason"))


@query(
    f"""WITH {V.ITEM}, {V.QUOTE}, l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)
 SELECT l_orderkey AS tender_id, l_linenumber AS ord, l_partkey AS partkey, l_suppkey AS suppkey, round(CASE WHEN l_quantity >= 40 THEN amount * 0.9::DOUBLE WHEN l_quantity >= 20 THEN amount * 0.95::DOUBLE ELSE amount END, 6) AS amount
 FROM l JOIN quote ON l_partkey = partkey AND l_suppkey = suppkey"""
)
def q_tier_price(spark, d):
    i = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity")
    )
    j = i.join(V.quote(spark, d), ["partkey", "suppkey"])
    return j.select("tender_id", "ord", "partkey", "suppkey", F.round(amounts.amount_for(F.col("amount"), F.col("tiers"), F.col("quantity")), 6).alias("amount"))


@query(
    f"""WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, {V.sql_tokens('p_name')} AS ts FROM n)
 SELECT a.p_name AS left_name, b.p_name AS right_name, round(CASE WHEN least(len(a.ts), len(b.ts)) = 0 THEN 0 ELSE len(list_intersect(a.ts, b.ts))::DOUBLE / least(len(a.ts), len(b.ts)) END, 6) AS overlap
 FROM t a JOIN t b ON len(list_intersect(a.ts, b.ts)) > 0"""
)
def q_title_overlap(spark, d):
    n = read(spark, d, "part").select("p_name").distinct().select("p_name", text.tokens(F.col("p_name")).alias("ts"))
    a, b = (n.select(F.col("p_name").alias(f"{s}_name"), F.col("ts").alias(f"{s}_ts"), F.explode("ts").alias("token")) for s in ("left", "right"))
    pairs = a.join(b, "token").dropDuplicates(["left_name", "right_name"])
    return pairs.select("left_name", "right_name", F.round(text.overlap(F.col("left_ts"), F.col("right_ts")), 6).alias("overlap"))


_MATCH = f"""WITH {V.PRODUCT}, p AS (SELECT *, {V.sql_tokens('title')} AS its, {V.sql_norm('title')} AS iname FROM product),
 o AS (SELECT *, {V.sql_tokens('product_name')} AS qts, {V.sql_norm('product_name')} AS qname FROM offer),
 pr AS (SELECT p.*, o.*, len(list_intersect(its, qts))::DOUBLE / least(len(its), len(qts)) AS ov, coalesce({V.sql_norm('maker')} = {V.sql_norm('q_maker')} AND maker <> '', false) AS mk,
  coalesce(model = q_model, false) AS md FROM p, o WHERE model = q_model OR len(list_intersect(its, qts))::DOUBLE / least(len(its), len(qts)) >= 0.34),
 l AS (SELECT *, CASE WHEN mk AND md THEN 85 WHEN md THEN 65 WHEN mk THEN 35 ELSE 0 END AS base FROM pr),
 s1 AS (SELECT *, CASE WHEN ov >= 0.34 AND base = 0 AND iname = qname THEN 75 WHEN ov >= 0.34 AND base = 0 THEN least(60, round_even(ov * 60, 0))::INT
  WHEN ov >= 0.34 THEN least(95, base + 5) ELSE base END AS s FROM l),
 s2 AS (SELECT *, CASE WHEN brand_locked AND maker IS NOT NULL AND NOT mk THEN least(s, 20) ELSE s END AS t FROM s1),
 s3 AS (SELECT *, (CASE WHEN unit <> 'STK' THEN least(t, 55) ELSE t END)::INT AS score,
  CASE basis WHEN 'NET' THEN amount WHEN 'GROSS' THEN amount / (1 + vat_rate) END AS net FROM s2),
 rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, CASE WHEN coalesce(amount, 0) = 0 THEN 'infinity'::DOUBLE ELSE amount END, quote_id) AS rank
  FROM s3 WHERE score > 0) WHERE rank <= 10)"""
_STAT = f"""{_MATCH}, ok AS (SELECT *, score >= 65 AND net IS NOT NULL AS good FROM rk),
 cc AS (SELECT item_id, currency AS cur, count(*) AS n, min(rank) AS f FROM ok WHERE good GROUP BY ALL),
 ld AS (SELECT item_id, min_by(cur, (-n, f)) AS lead FROM cc GROUP BY item_id),
 st AS (SELECT ok.item_id, count(*) AS offer_count, count(*) FILTER (good AND currency = lead) AS usable_count, any_value(lead) AS currency,
  min(net) FILTER (good AND currency = lead) AS minimum, median(net) FILTER (good AND currency = lead) AS median, max(net) FILTER (good AND currency = lead) AS maximum,
  max(score) AS best_score FROM ok LEFT JOIN ld USING (item_id) GROUP BY ok.item_id)"""
#: These price lists name makers only roughly: offers count from 65 points on.
_PARAMS = pricing.Params(minimum_confidence=65)


def _scored(spark, d):
    i, q = V.product(spark, d), V.offer(spark, d)
    pairs = pricing.candidates(i, q).join(pricing.with_item_keys(i).drop("article_number", "model_number", "manufacturer"), "item_id")
    q = pricing.with_quote_keys(q).drop("article_number", "model_number", "manufacturer")
    return pricing.score(pairs.join(q, "quote_id"))


def _ranked(spark, d):
    net = amounts.net_amount(F.col("amount"), F.col("basis"), F.col("vat_rate"))["net"]
    return pricing.rank(_scored(spark, d)).withColumn("net", net)


def _stats(spark, d):
    return pricing.price_statistics(_ranked(spark, d), _PARAMS)


@query(f"{_MATCH} SELECT item_id, quote_id, score, round(ov, 6) AS overlap FROM s3")
def q_match_score(spark, d):
    return _scored(spark, d).select("item_id", "quote_id", "score", F.round("overlap", 6).alias("overlap"))


@query(f"{_MATCH} SELECT item_id, quote_id, score, rank::INT AS rank FROM rk")
def q_match_topk(spark, d):
    return _ranked(spark, d).select("item_id", "quote_id", "score", "rank")


@query(f"{_MATCH} SELECT item_id, min_by(quote_id, (-score, amount, rank)) AS quote_id, max(score) AS score, min_by(amount, (-score, amount, rank)) AS amount FROM rk WHERE amount IS NOT NULL GROUP BY item_id")
def q_best_match(spark, d):
    return pricing.best_match(_ranked(spark, d))


@query(
    f"""{_STAT} SELECT item_id, offer_count, usable_count, currency, round(minimum, 6) AS minimum, round(median, 6) AS median, round(maximum, 6) AS maximum,
 round(CASE WHEN median <> 0 THEN (maximum - minimum) / median END, 6) AS spread_ratio FROM st"""
)
def q_price_statistics(spark, d):
    rounded = [F.round(c, 6).alias(c) for c in ("minimum", "median", "maximum", "spread_ratio")]
    return _stats(spark, d).select("item_id", "offer_count", "usable_count", "currency", *rounded)


@query(
    f"""{_STAT} SELECT p.tender_id, count(*) AS n_items, count(*) FILTER (coalesce(offer_count, 0) > 0) AS n_priced, count(*) FILTER (coalesce(usable_count, 0) > 0) AS n_usable,
 round_even(count(*) FILTER (coalesce(usable_count, 0) > 0) * 100 / count(*), 0)::INT AS coverage_percent FROM product p LEFT JOIN st USING (item_id) GROUP BY p.tender_id"""
)
def q_price_coverage(spark, d):
    return pricing.coverage(V.product(spark, d), _stats(spark, d))


@query(
    f"""{_STAT} SELECT item_id, concat_ws(';', CASE WHEN usable_count = 0 AND best_score < 65 THEN 'best offer is under the least score' WHEN usable_count = 0
 THEN 'no offer can be calculated with' WHEN usable_count = 1 THEN 'single offer' END, CASE WHEN median <> 0 AND (maximum - minimum) / median > 0.5 THEN 'prices spread widely' END) AS warnings FROM st"""
)
def q_price_warnings(spark, d):
    return _stats(spark, d).select("item_id", F.array_join("warnings", ";").alias("warnings"))


# --- runs -------------------------------------------------------------------------------------------------------------
def _runs(spark, d):
    return read(spark, d, "events").select((F.col("user_id") % 10).alias("source"), "ts", F.col("event_id").alias("run_id"), (F.col("event_type") != "error").alias("ok"), "value")


@query(
    """WITH r AS (SELECT user_id % 10 AS source, ts, event_id, event_type <> 'error' AS ok FROM events),
 l AS (SELECT source, max((ts, event_id)) FILTER (ok) AS s FROM r GROUP BY source)
 SELECT r.source, count(*) AS n_runs, count(*) FILTER (NOT ok AND (s IS NULL OR (ts, event_id) > s)) AS consecutive_failures, max(ts) AS last_run_at, max(ts) FILTER (ok) AS last_success_at
 FROM r JOIN l USING (source) GROUP BY r.source"""
)
def q_source_failures(spark, d):
    return runs.source_state(_runs(spark, d))


@query(f"{WITH} SELECT count(*) AS n_rows, count(*) FILTER (title IS NOT NULL AND deadline IS NOT NULL) AS n_usable, count(title) AS n_title, count(deadline) AS n_deadline, count(estimated_value) AS n_estimated_value FROM notice")
def q_source_health(spark, d):
    fields = {c: F.col(c) for c in ("title", "deadline", "estimated_value")}
    return runs.fill_rates(V.notice(spark, d), fields, ("title", "deadline"))


@query("SELECT user_id % 10 AS source, ts, event_id AS run_id, event_type <> 'error' AS ok, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def q_last_runs(spark, d):
    return runs.last_runs(_runs(spark, d), 20)
