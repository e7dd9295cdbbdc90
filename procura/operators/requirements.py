"""Requirements in documents: sentences by rules, with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from procura.functions import constants as C
from procura.functions.text import sentences, shorten


def find(pages: DataFrame, rules: tuple = C.RULES, per_kind: int = C.FINDINGS_PER_KIND) -> DataFrame:
    """``(tender_id, kind, label, value, confidence, evidence, doc, page, sentence_no, rule_no)``.

    ``pages(tender_id, doc, page, text)``; ``doc`` and ``page`` order the text.  Each sentence is tried against each
    rule in the row (no join); of a kind's equal sentences the first counts, then the first ``per_kind`` in order.
    """
    s = pages.select("tender_id", "doc", "page", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    hits = []
    for i, (kind, pattern, label, confidence, has_value) in enumerate(rules):
        p = pattern if pattern.startswith("(?") and "iU" in pattern[:6] else "(?iU)" + pattern
        value = F.trim(F.regexp_replace(F.regexp_extract("sentence", p, 1), r"\s+", " ")) if has_value else F.lit(None).cast("string")
        row = F.struct(
            F.lit(i).alias("rule_no"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), value.alias("value"), F.lit(confidence).alias("confidence")
        )
        hits.append(F.when(F.col("sentence").rlike(p), row))
    found = s.select("tender_id", "doc", "page", "sentence_no", "sentence", F.inline(F.array_compact(F.array(*hits))))
    order = ["doc", "page", "sentence_no", "rule_no"]
    first = W.partitionBy("tender_id", "kind", F.lower("sentence")).orderBy(*order)
    some = found.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    some = some.withColumn("nth", F.row_number().over(W.partitionBy("tender_id", "kind").orderBy(*order))).where(F.col("nth") <= per_kind)
    return some.select("tender_id", "kind", "label", "value", "confidence", shorten(F.col("sentence")).alias("evidence"), *order)


def has_clause(text: Column, pattern: str = C.EQUIVALENCE) -> Column:
    return text.rlike(pattern)


def equivalence_scope(pages: DataFrame, findings: DataFrame, pattern: str = C.EQUIVALENCE, kind: str = "BRAND_LOCK") -> DataFrame:
    """``(tender_id, scope)``: inline if each brand finding carries the clause, document if a text does, else none."""
    docs = pages.groupBy("tender_id").agg(F.coalesce(F.bool_or(has_clause(F.col("text"), pattern)), F.lit(False)).alias("somewhere"))
    brand = findings.where(F.col("kind") == kind).groupBy("tender_id").agg(F.bool_and(has_clause(F.col("evidence"), pattern)).alias("inline"))
    scope = F.when(F.col("inline"), "inline").when(F.col("somewhere"), "document").otherwise("none")
    return docs.join(brand, "tender_id", "left").select("tender_id", scope.alias("scope"))


def requirement_lists(findings: DataFrame) -> DataFrame:
    """A row a tender: evidence lists by kind in order, distinct certificates, first delivery and payment terms."""
    at = F.struct("doc", "page", "sentence_no", "rule_no")

    def listed(kind: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(at.alias("at"), "evidence"))))
        return F.transform(rows, lambda r: r["evidence"])

    name = F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("evidence"))
    certs = findings.where("kind = 'CERTIFICATION'").groupBy("tender_id", F.lower(name).alias("k")).agg(F.min(F.struct(at.alias("at"), name.alias("name"))).alias("c"))
    certs = certs.groupBy("tender_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["name"]).alias("certifications"))
    firsts = {k: F.min_by("evidence", F.when(F.col("kind") == k, at)) for k in ("DELIVERY_TERMS", "PAYMENT_TERMS")}
    out = findings.groupBy("tender_id").agg(
        *[listed(k).alias(k.lower()) for k in ("ELIGIBILITY", "TECHNICAL", "MINIMUM", "AWARD_CRITERIA")],
        *[F.when(F.bool_or(F.col("kind") == k), x).alias(k.lower()) for k, x in firsts.items()],
    )
    return out.join(certs, "tender_id", "left")
