"""Additive risk score: factors with points, a sum capped at 100, a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.functions.dates import days_until

# Least score of a level.
LEVELS = ((70, "VERY_HIGH"), (45, "HIGH"), (20, "MEDIUM"))


def level(score: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def digits(x: Column) -> Column:
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """A row a tender of what the factors ask of its findings; one aggregation."""
    kind = F.col("kind")
    cert = F.lower(F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("label")))
    return findings.groupBy("tender_id").agg(
        *[F.count_if(kind == k).alias(k.lower()) for k in ("PENALTY", "SECURITY", "BRAND_LOCK", "MINIMUM", "AWARD_CRITERIA")],
        F.count_distinct(F.when(kind == "CERTIFICATION", cert)).alias("certificates"),
        F.max(F.when(kind == "PAYMENT_TERMS", digits(F.col("value")))).alias("payment_days"),
        F.max(F.when(kind == "DELIVERY_TERMS", digits(F.col("value")))).alias("sites"),
    )


def assess(tenders: DataFrame, as_of: Column) -> DataFrame:
    """``tender_id, score, level, factors`` of one wide row a tender.

    Needs ``deadline, estimated_value, delivery_date, n_documents, n_unreadable, n_readable, n_chars, scope`` and the
    columns of ``finding_counts()`` (null counts as none).  ``factors`` is ``array<struct<code, points>>``, most points
    first, in the order of the rules among equals.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    days = days_until(F.col("deadline"), as_of)
    docs, certs, sites = n("n_documents") > 0, n("certificates"), n("sites")
    until = F.date_diff(F.col("delivery_date"), F.to_date(as_of))
    brand = n("brand_lock") > 0
    # Code, condition, points.
    rules = [
        ("deadline_passed", days < 0, 40),
        ("deadline_very_tight", (days >= 0) & (days < 7), 25),
        ("deadline_tight", (days >= 7) & (days < 14), 12),
        ("deadline_unknown", F.col("deadline").isNull(), 15),
        ("value_unknown", F.col("estimated_value").isNull(), 12),
        ("documents_missing", ~docs, 20),
        ("documents_unreadable", n("n_unreadable") > 0, F.least(n("n_unreadable") * 8, F.lit(24))),
        ("content_thin", (n("n_readable") > 0) & (n("n_chars") < 1500), 10),
        ("contract_penalty", n("penalty") > 0, 15),
        ("security_required", n("security") > 0, 12),
        ("many_certifications", certs >= 3, F.least(certs * 4, F.lit(20))),
        ("certifications_required", (certs >= 1) & (certs < 3), 5),
        ("brand_lock_with_equivalence", brand & (F.col("scope") == "inline"), 5),
        ("brand_lock_general_clause", brand & (F.col("scope") == "document"), 10),
        ("brand_lock_strict", brand & (F.coalesce("scope", F.lit("none")) == "none"), 18),
        ("delivery_many_sites", sites >= 5, F.least(F.floor(sites / 5) * 2, F.lit(15))),
        ("delivery_lead_time_short", until < 30, F.when(until < 15, 15).otherwise(8)),
        ("payment_terms_long", n("payment_days") >= 45, 10),
        ("many_minimum_requirements", n("minimum") >= 5, 8),
        ("award_criteria_unclear", docs & (n("award_criteria") == 0), 8),
    ]
    found = [
        F.when(cond, F.struct((-(F.lit(points) if isinstance(points, int) else points)).cast("int").alias("minus"), F.lit(i).alias("ord"), F.lit(code).alias("code")))
        for i, (code, cond, points) in enumerate(rules)
    ]
    factors = F.transform(
        F.array_sort(F.array_compact(F.array(*found))), lambda f: F.struct(f["code"].alias("code"), (-f["minus"]).alias("points"))
    )
    out = tenders.select("tender_id", factors.alias("factors"))
    score = F.least(F.lit(100), F.aggregate("factors", F.lit(0), lambda a, f: a + f["points"]))
    return out.select("tender_id", score.alias("score"), level(score).alias("level"), "factors")
