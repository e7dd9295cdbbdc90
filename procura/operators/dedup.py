"""Duplicates across sources: exact number, fingerprint, then similar titles in a block; and who is primary.

Records of one source never match each other, so that a batch of a source is one set operation.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from procura.functions.text import blocking_key, fingerprint, normalize_text
from procura.params import DEFAULTS, Params


def with_keys(notices: DataFrame) -> DataFrame:
    """Adds what the joins use: normalised title and authority, blocking key, fingerprint."""
    return notices.withColumns(
        {
            "title_normalized": normalize_text(F.col("title")),
            "authority_normalized": normalize_text(F.col("authority")),
            "blocking_key": blocking_key(F.col("title"), F.col("authority")),
            "fingerprint": fingerprint(F.col("national_id").cast("string"), F.col("title"), F.col("authority"), F.col("deadline")),
        }
    )


def in_window(new: Column, old: Column, days: int) -> Column:
    """An old date within the days of a new one; a missing date on either side restricts nothing."""
    return new.isNull() | old.isNull() | old.between(F.date_sub(new, days), F.date_add(new, days))


def exact_matches(new: DataFrame, store: DataFrame, key: str, reason: str, confidence: int) -> DataFrame:
    """``(id, candidate, reason, confidence)``: the first record (first seen, then id) of another source with the key.

    The store is reduced to the first record a key and source before the join, so that rows are new records times sources,
    however many records share a key.
    """
    usable = F.length(F.col(key).cast("string")) > 0
    first = store.where(usable).groupBy(F.col(key).alias("k"), F.col("source").alias("of")).agg(F.min(F.struct("first_seen", "id")).alias("b"))
    found = new.where(usable).select("id", "source", F.col(key).alias("k")).join(first, "k").where("source <> of")
    best = found.groupBy("id").agg(F.min("b").alias("b"))
    return best.select("id", F.col("b.id").alias("candidate"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))


def _within_days(new: DataFrame, store: DataFrame, key: str, days: int, *cols: str | Column) -> DataFrame:
    """Pairs of one key and different sources whose dates are ``in_window``; a bucket of days is part of the join's key.

    Only records without a date, which restrict nothing, are joined by the key alone.
    """
    bucket = F.floor(F.datediff("publication_date", F.lit("1970-01-01").cast("date")) / max(days, 1))
    dated, undated = F.col("publication_date").isNotNull(), F.col("publication_date").isNull()
    base = (F.col(f"n.{key}") == F.col(f"s.{key}")) & (F.col("n.source") != F.col("s.source"))
    n = new.where(dated).withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))).alias("n")
    s = store.where(dated).withColumn("bucket", bucket).alias("s")
    window = in_window(F.col("n.publication_date"), F.col("s.publication_date"), days)
    close = n.join(s, base & (F.col("n.bucket") == F.col("s.bucket")) & window).select(*cols)
    free = new.where(undated).alias("n").join(store.alias("s"), base).select(*cols)
    return close.union(free).union(new.where(dated).alias("n").join(store.where(undated).alias("s"), base).select(*cols))


def candidates(new: DataFrame, store: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pairs to compare: all of the same block, then of the same authority the newest ``authority_candidates``."""
    new = new.where("title_normalized <> ''")
    texts = [F.col(f"{a}.{c}").alias(f"{c}_{b}") for a, b in (("n", "new"), ("s", "old")) for c in ("title_normalized", "authority_normalized")]
    cols = ["n.id", F.col("s.id").alias("candidate"), *texts]
    block = _within_days(new, store, "blocking_key", p.window_days, *cols, F.lit(0).alias("grp"))
    newest = W.partitionBy("id").orderBy(F.col("last_seen_at").desc(), "candidate")
    other = F.col("n.blocking_key").eqNullSafe(F.col("s.blocking_key")).alias("same_block")
    near = (
        _within_days(new.where("authority_normalized <> ''"), store, "authority_normalized", p.window_days, *cols, F.lit(1).alias("grp"), "s.last_seen_at", other)
        .where("NOT same_block")
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= p.authority_candidates)
        .drop("rank", "last_seen_at", "same_block")
    )
    return block.unionByName(near)


@F.pandas_udf(DoubleType())
def similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching blocks, 0 for an empty text.  It is not symmetric: the new text comes first."""
    for left, right in parts:
        yield pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)], dtype="float64")


def fuzzy_matches(pairs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(id, candidate, reason, confidence)``: the best scored pair of each new record, ties to the first block and id."""
    t, a = F.col("t"), F.col("a")
    comparable = (F.col("authority_normalized_new") != "") & (F.coalesce("authority_normalized_old", F.lit("")) != "")
    # Equal texts need no comparison; authorities are compared only where titles pass.
    title = F.when(F.col("title_normalized_new") == F.col("title_normalized_old"), 1.0).otherwise(similarity("title_normalized_new", "title_normalized_old"))
    # A ratio is 2 * matches / (both lengths), and the shorter text bounds the matches: most pairs go before Python sees them.
    n, m = F.length("title_normalized_new"), F.length("title_normalized_old")
    possible = (n + m > 0) & (2.0 * F.least(n, m) >= p.title_similarity * (n + m) - 1e-9)
    passed = pairs.where(possible).withColumn("t", title).where(t >= p.title_similarity)
    auth = F.when(F.col("authority_normalized_new") == F.col("authority_normalized_old"), 1.0).otherwise(
        similarity("authority_normalized_new", "authority_normalized_old")
    )
    scored = passed.withColumn("a", F.when(comparable, auth))
    confidence = F.when(a.isNull() & (t >= p.title_alone), F.floor(t * 90)).when(a >= p.authority_similarity, F.floor((t * 0.7 + a * 0.3) * 100))
    scored = scored.withColumn("confidence", confidence.cast("int")).where("confidence IS NOT NULL")
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "grp", "candidate")).alias("b"))
    return best.select("id", F.col("b.candidate").alias("candidate"), F.lit("title_similarity").alias("reason"), (-F.col("b.c")).cast("int").alias("confidence"))


def find_duplicates(new: DataFrame, store: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The duplicate of each new record that has one: number before fingerprint before similar title."""
    by_number = exact_matches(new, store, "national_id", "national_id", 100).withColumn("stage", F.lit(0))
    by_print = exact_matches(new, store, "fingerprint", "fingerprint", 98).withColumn("stage", F.lit(1))
    exact = by_number.union(by_print)
    left = new.join(exact.select("id").distinct(), "id", "left_anti")
    fuzzy = fuzzy_matches(candidates(left, store, p), p).withColumn("stage", F.lit(2))
    found = exact.unionByName(fuzzy)
    best = found.groupBy("id").agg(F.min(F.struct("stage", "candidate", "reason", "confidence")).alias("b"))
    return best.select("id", "b.candidate", "b.reason", "b.confidence")


def elect_primary(members: DataFrame) -> DataFrame:
    """``members(group, id, priority, arrival)`` with ``primary_id, is_primary``: lowest priority, then first arrival.

    The election is an aggregation joined back, so that no group has to fit one task.
    """
    first = members.groupBy("group").agg(F.min(F.struct("priority", "arrival", "id")).alias("b"))
    out = members.join(first.select("group", F.col("b.id").alias("primary_id")), "group")
    return out.withColumn("is_primary", F.col("id") == F.col("primary_id"))
