"""Change detection, change log and merge of a batch into a store, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdicts(batch: DataFrame, store: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``(id, action)``: updated or unchanged by content hash if the id is known, else duplicate or new."""
    b, s, d = batch.alias("b"), store.alias("s"), duplicates.select("id").distinct().alias("d")
    joined = b.join(s, F.col("b.id") == F.col("s.id"), "left").join(d, F.col("b.id") == F.col("d.id"), "left")
    action = (
        F.when(F.col("s.id").isNotNull() & (F.col("b.content_hash") == F.col("s.content_hash")), "unchanged")
        .when(F.col("s.id").isNotNull(), "updated")
        .when(F.col("d.id").isNotNull(), "duplicate")
        .otherwise("new")
    )
    return joined.select("b.id", "b.source", action.alias("action"))


def change_log(batch: DataFrame, store: DataFrame, fields: dict[str, Column | None]) -> DataFrame:
    """``(id, field, old_value, new_value)`` of each watched field that differs, null-safe.

    A field with a Column of its own is shown by it (a long text as a marker, a set of links as a number).
    """
    b, s = batch.alias("b"), store.alias("s")
    rows = []
    for name, shown in fields.items():
        show = lambda side: (F.col(f"{side}.{name}").cast("string") if shown is None else shown)  # noqa: B023, E731
        differs = ~F.col(f"b.{name}").eqNullSafe(F.col(f"s.{name}"))
        rows.append(F.when(differs, F.struct(F.lit(name).alias("field"), show("s").alias("old_value"), show("b").alias("new_value"))))
    found = b.join(s, F.col("b.id") == F.col("s.id")).select(F.col("b.id").alias("id"), F.inline(F.array_compact(F.array(*rows))))
    return found


def merge(batch: DataFrame, store: DataFrame, cols: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """The store after the batch: new rows come in, known ones are overwritten, others stay; one full outer join."""
    b, s = batch.alias("b"), store.alias("s")

    def merged(c: str) -> Column:
        if c == "id":
            return F.coalesce("b.id", "s.id").alias("id")
        fresh = F.coalesce(f"b.{c}", f"s.{c}") if c in keep_if_null else F.col(f"b.{c}")
        return F.when(F.col("b.id").isNotNull(), fresh).otherwise(F.col(f"s.{c}")).alias(c)

    return b.join(s, F.col("b.id") == F.col("s.id"), "full").select(*[merged(c) for c in ["id", *cols]])


def ingest_report(actions: DataFrame) -> DataFrame:
    """Found, new, updated, unchanged and duplicate by source, with a grand total (source null)."""
    n = lambda a: F.count_if(F.col("action") == a).alias(f"n_{a}")
    return actions.rollup("source").agg(F.count(F.lit(1)).alias("n_found"), n("new"), n("updated"), n("unchanged"), n("duplicate"))


def pending(open_notices: DataFrame, runs: DataFrame) -> DataFrame:
    """Notices whose last run saw other content, or that have none: a left anti join on id and hash."""
    return open_notices.join(runs.select("id", "content_hash").distinct(), ["id", "content_hash"], "left_anti")
