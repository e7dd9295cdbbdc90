"""Runs and health: consecutive failures, fill rates, last runs, character budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def source_state(runs: DataFrame) -> DataFrame:
    """``runs(source, ts, run_id, ok)`` to a row a source: failures since the last success, last run, last success.

    Two aggregations instead of an ordered pass: the failures after the last success are the current streak.
    """
    at = F.struct("ts", "run_id")
    last = runs.groupBy("source").agg(F.max(F.when(F.col("ok"), at)).alias("s"), F.max(at).alias("l"), F.count(F.lit(1)).alias("n_runs"))
    after = F.col("s").isNull() | (at > F.col("s"))
    streak = runs.join(last, "source").groupBy("source").agg(F.count_if(~F.col("ok") & after).alias("consecutive_failures"))
    return last.join(streak, "source").select("source", "n_runs", "consecutive_failures", F.col("l.ts").alias("last_run_at"), F.col("s.ts").alias("last_success_at"))


def fill_rates(rows: DataFrame, fields: dict[str, Column], required: tuple[str, ...]) -> DataFrame:
    """One row: rows, rows with all required fields, and for each field how many have it."""
    full = F.lit(True)
    for f in required:
        full = full & fields[f].isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(full).alias("n_usable"), *[F.count(c).alias(f"n_{f}") for f, c in fields.items()])


def last_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.col("ts").desc(), F.col("run_id").desc()).limit(n)


def character_budget(pages: DataFrame, limit: int) -> DataFrame:
    """Pages up to ``limit`` characters a document: the one that crosses is cut, later ones go; ``truncated`` says so."""
    w = W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, W.currentRow)
    p = pages.withColumn("n", F.length("text")).withColumn("total", F.sum("n").over(w))
    room = F.lit(limit) - (F.col("total") - F.col("n"))
    p = p.withColumn("room", room).where("room > 0")
    return p.select("doc", "page", F.substring(F.col("text"), F.lit(1), F.least(F.col("room"), F.col("n")).cast("int")).alias("text"), (F.col("n") > F.col("room")).alias("truncated"))
