"""The ingest of a run: sources in order of priority, each one batch against the store that those before it left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.functions.text import content_hash, normalize_text
from procura.operators import dedup, upsert
from procura.params import DEFAULTS, Params

#: Fields whose changes are logged, in order.
WATCHED = ("title", "authority", "description", "deadline", "estimated_value", "status", "national_id")
HASHED_DESCRIPTION = 2000  # characters of the normalised description that the content hash sees
ALIASES = "tender_id string, source string, source_id string, source_url string, reason string, confidence int"
#: What the store keeps of a notice beside what it was delivered with.
KEPT = ("first_seen", "last_seen_at", "content_hash", "primary_id", "is_primary")


def links_of(documents: Column) -> Column:
    """The links of a notice's documents, or their names without one, sorted."""
    return F.array_sort(F.transform(F.coalesce(documents, F.array()), lambda d: F.coalesce(d["url"], d["name"], F.lit(""))))


def notice_hash() -> Column:
    """The content hash of a notice: title, description, deadline, value, status, sorted codes, number of lots, links."""
    return content_hash(
        normalize_text(F.col("title")),
        F.substring(normalize_text(F.col("description")), 1, HASHED_DESCRIPTION),
        F.date_format("deadline", "yyyy-MM-dd HH:mm:ss"),
        F.col("estimated_value").cast("decimal(18,2)"),
        F.col("status"),
        F.array_join(F.array_sort(F.coalesce("cpv_codes", F.array().cast("array<string>"))), ","),
        F.coalesce(F.size("lots"), F.lit(0)),
        F.array_join(links_of(F.col("documents")), ","),
    )


def new_links(batch: DataFrame, store: DataFrame) -> DataFrame:
    """``(id, url)``: links of documents that the store's notice of the same id doesn't have."""
    of = lambda df: df.select("id", F.explode(F.array_distinct(links_of(F.col("documents")))).alias("url"))
    return of(batch).join(of(store), ["id", "url"], "left_anti")


def changes(batch: DataFrame, store: DataFrame) -> DataFrame:
    """``(id, field, old_value, new_value)`` of notices whose content hash differs.

    A long text shows that it changed, not how; documents count if the set of their links differs, and show their number.
    """
    b, s = batch.alias("b"), store.alias("s")
    rows = []
    for name in WATCHED:
        differs = ~F.col(f"b.{name}").cast("string").eqNullSafe(F.col(f"s.{name}").cast("string"))
        show = lambda side: F.lit("(changed)") if name == "description" else F.col(f"{side}.{name}").cast("string")  # noqa: B023, E731
        rows.append(F.when(differs, F.struct(F.lit(name).alias("field"), show("s").alias("old_value"), show("b").alias("new_value"))))
    urls = lambda side: F.array_distinct(links_of(F.col(f"{side}.documents")))
    number = lambda side: F.size(urls(side)).cast("string")
    rows.append(F.when(urls("b") != urls("s"), F.struct(F.lit("documents").alias("field"), number("s").alias("old_value"), number("b").alias("new_value"))))
    joined = b.join(s, F.col("b.id") == F.col("s.id")).where(~F.col("b.content_hash").eqNullSafe(F.col("s.content_hash")))
    return joined.select(F.col("b.id").alias("id"), F.inline(F.array_compact(F.array(*rows))))


def linked(found: DataFrame, store: DataFrame, priority: int, priorities: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(id, old_primary, primary_id, is_primary)`` of the duplicates ``found(id, candidate, ...)`` of one source.

    A candidate stands for its own primary, one step on.  If the source goes before the primary's, the first new record
    (by id) becomes the primary and the others hang on it; else all hang on the old one.
    """
    s = store.select(F.col("id").alias("candidate"), F.coalesce("primary_id", "id").alias("old_primary"))
    of = store.select(F.col("id").alias("old_primary"), "source").join(priorities, "source", "left")
    of = of.select("old_primary", F.coalesce("priority", F.lit(p.default_priority)).alias("old_priority"))
    d = found.join(s, "candidate").join(of, "old_primary")
    first = d.groupBy("old_primary").agg(F.min("id").alias("first"))
    wins = F.lit(priority) < F.col("old_priority")
    d = d.join(first, "old_primary").withColumn("primary_id", F.when(wins, F.col("first")).otherwise(F.col("old_primary")))
    return d.select("id", "old_primary", "primary_id", (F.col("id") == F.col("primary_id")).alias("is_primary"), "reason", "confidence")


def alias_edges(links: DataFrame, batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of ``ALIASES``: the record that is no primary, under the one that is.

    A new primary takes the old one as its alias; any other duplicate is an alias of its primary.
    """
    rows = lambda df: df.select("id", "source", "source_id", "source_url")
    known = rows(batch).unionByName(rows(store)).withColumnRenamed("id", "alias_id")
    edge = links.select(
        F.col("primary_id").alias("tender_id"), F.when(F.col("is_primary"), F.col("old_primary")).otherwise(F.col("id")).alias("alias_id"), "reason", "confidence"
    )
    return edge.join(known, "alias_id").select("tender_id", "source", "source_id", "source_url", "reason", "confidence")


def reparented(store: DataFrame, links: DataFrame) -> DataFrame:
    """The store in which old primaries that lost, and their children, hang on the new primary."""
    moved = links.where("is_primary").select(F.col("old_primary").alias("was"), F.col("id").alias("now"))
    m = store.withColumn("was", F.coalesce("primary_id", "id")).join(moved, "was", "left")
    lost = F.col("now").isNotNull()
    m = m.withColumns({"primary_id": F.coalesce("now", "primary_id"), "is_primary": F.when(lost, F.lit(False)).otherwise(F.col("is_primary"))})
    return m.select(*store.columns)


def writer(spark: SparkSession, out: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a table under ``out`` by a name and reads it again: what several results need is computed once."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(schema).parquet(f"{out}/{name}")

    return keep


def apply_batch(
    batch: DataFrame, store: DataFrame, priority: int, priorities: DataFrame, keep: Callable[[DataFrame, str], DataFrame], p: Params = DEFAULTS
) -> dict[str, DataFrame]:
    """One source's delivery against the store: ``actions, changes, aliases, store`` (after it).

    Known ids are updated if their content hash differs and keep a national number that the delivery lacks; others are
    new, or duplicates of another source's record; duplicates come into the store too, under their primary.  ``batch``
    has the columns of a notice and ``last_seen_at``, one row an id; ``store`` has ``KEPT`` as well.  ``keep`` is a ``writer``.
    """
    b = dedup.with_keys(batch.withColumn("first_seen", F.col("last_seen_at"))).withColumn("content_hash", notice_hash())
    b = keep(b, "batch")
    unknown = b.join(store.select("id"), "id", "left_anti")
    found = keep(dedup.find_duplicates(keep(unknown, "unknown"), keep(dedup.with_keys(store), "keyed"), p), "found")
    actions = upsert.verdicts(b, store, found)
    links = keep(linked(found, store, priority, priorities, p), "links")
    delivered = [c for c in batch.columns if c != "id"]
    fresh = b.join(links.select("id", "primary_id", "is_primary"), "id", "left").withColumn("is_primary", F.coalesce("is_primary", F.lit(True)))
    kept = reparented(store, links)
    cols = [*delivered, *[c for c in KEPT if c not in delivered]]
    n, s = fresh.alias("n"), kept.alias("s")
    known = F.col("s.id").isNotNull()

    def merged(c: str) -> Column:
        if c in ("first_seen", "primary_id", "is_primary"):
            return F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        new = F.coalesce(f"n.{c}", f"s.{c}") if c == "national_id" else F.col(f"n.{c}")
        return F.when(F.col("n.id").isNotNull(), new).otherwise(F.col(f"s.{c}")).alias(c)

    after = n.join(s, F.col("n.id") == F.col("s.id"), "full").select(F.coalesce("n.id", "s.id").alias("id"), *[merged(c) for c in cols])
    return {"actions": actions, "changes": changes(b, store), "aliases": alias_edges(links, b, store), "store": after}


@dataclass
class Run:
    """What a run left: the store, and tables of all sources' actions, changes, aliases and failures."""

    store: DataFrame
    actions: DataFrame
    changes: DataFrame
    aliases: DataFrame
    failures: list[tuple[str, str]] = field(default_factory=list)

    def report(self) -> DataFrame:
        """Found, new, updated, unchanged and duplicate by source and in all; a failed source has its error and no counts."""
        of = upsert.ingest_report(self.actions).withColumn("error", F.lit(None).cast("string"))
        spark = self.store.sparkSession
        return of.unionByName(spark.createDataFrame(self.failures, "source string, error string"), allowMissingColumns=True) if self.failures else of


def run(spark: SparkSession, sources: list[tuple[str, int, Callable[[], DataFrame]]], store: DataFrame, out: str, p: Params = DEFAULTS) -> Run:
    """Sources ``(name, priority, read)`` one after the other, those of the lowest priority first.

    Every step's tables are written under ``out``, a shared folder, and read again, so that lineage does not grow and a lost
    executor costs one step.  A source that fails is noted and leaves the store as it was.
    """
    priorities = spark.createDataFrame([(n, q) for n, q, _ in sources] or [("", 0)], "source string, priority int")
    paths: dict[str, list[str]] = {"actions": [], "changes": [], "aliases": []}
    failures = []
    for i, (name, priority, read) in enumerate(sorted(sources, key=lambda s: (s[1], s[0]))):
        try:
            step = apply_batch(read(), store, priority, priorities, writer(spark, f"{out}/step={i}"), p)
            for kind, df in step.items():
                df.write.mode("overwrite").parquet(f"{out}/step={i}/{kind}")
        except Exception as e:  # noqa: BLE001  one source does not stop the others
            failures.append((name, f"{type(e).__name__}: {str(e)[:200]}"))
            continue
        store = spark.read.parquet(f"{out}/step={i}/store")
        for kind in paths:
            paths[kind].append(f"{out}/step={i}/{kind}")
    empty = {
        "actions": "id string, source string, action string", "changes": "id string, field string, old_value string, new_value string", "aliases": ALIASES,
    }
    tables = {k: spark.read.schema(empty[k]).parquet(*v) if v else spark.createDataFrame([], empty[k]) for k, v in paths.items()}
    return Run(store, failures=failures, **tables)
