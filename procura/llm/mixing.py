"""Mixing sources to target weights: hash-random keys, range order, distributed prefix sums, exact cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from procura.llm.common import cut, n_words, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words, over all sources
CAP = 2  # epochs at most
SEED = "mix-1"
#: Hex digits of the key that name its range.  16**3 equal ranges a source: a hash is uniform, so that ranges need
#: no sampling, and a third of 30 billion rows still gives ranges of a few million rows.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``; targets are filled up like water.

    Sources in code point order, null last, weigh 3, 1, 2 and so on.  A target stops at twice its source's size and
    the excess is shared again by weight: with sources in order of ``cap / weight`` the common level is the first
    ``(budget - caps before) / weights left`` that does not pass its own source's ratio.
    The table has one row a source, and one task orders it: meant for named sources, thousands of them, not for a source a host.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1)
    one = W.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("rank", F.row_number().over(one)).withColumn("weight", w.cast("long"))
    order = W.orderBy((F.lit(float(CAP)) * F.col("source_size") / F.col("weight")), "rank")
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum(F.col("source_size") * CAP).over(upto), F.lit(0)))
        .withColumn("weights_left", F.col("weights") - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("level", (F.lit(SHARE) * F.col("total") - F.col("caps_before")) / F.col("weights_left"))
        .withColumn("fits", F.col("level") <= F.lit(float(CAP)) * F.col("source_size") / F.col("weight"))
        .withColumn("common", F.min(F.when(F.col("fits"), F.struct("caps_before", "rank", "level"))).over(everything))
    )
    capped = F.lit(float(CAP)) * F.col("source_size")
    target = F.when(F.col("common").isNull(), capped).otherwise(F.least(capped, F.col("common.level") * F.col("weight")))
    return filled.select("source", "source_size", target.alias("target"))


def _mixed(docs: DataFrame, *rest: str) -> DataFrame:
    """Each row of ``docs`` with what the mix takes of it, and the columns ``rest`` carried along, under ``rest``."""
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = n_words(F.col("text"))
    carried = F.struct(F.lit(0).alias("_"), *rest).alias("rest")
    # The text's hash is last in the order, so that reruns agree on rows of one id and size.
    rows = docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.xxhash64("text").alias("th"), carried)
    if not rest:
        rows = cut(rows, "mix-sizes")
        sized = rows
    else:
        sized = cut(docs.select("source", size.alias("size"), key.alias("key")), "mix-sizes")
    of_range = F.substring("key", 1, RANGE_DIGITS).alias("range")
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size", "th").rowsBetween(W.unboundedPreceding, -1)
    inner = rows.select("*", of_range).withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    totals = sized.groupBy("source", of_range).agg(F.sum("size").alias("in_range"))
    over = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("in_range").over(over), F.lit(0)))
    # One small table carries a range's offset and its source's target, so that rows are joined once.
    targets = source_targets(sized)
    o, t = offsets.alias("o"), targets.alias("t")
    side = o.join(t, F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("s"), F.col("o.range").alias("r"), "offset", "source_size", "target"
    )
    joined = inner.join(side, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inner")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    taken = (epochs * F.col("size") + part).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), epochs.alias("epochs"), part.alias("part"), "rest")


def mix(docs: DataFrame) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` has ``doc_id, text, source``; other columns are ignored.  Returns
    ``doc_id, size, source_size, target, taken, epochs``: whole epochs of a source come first, then documents in order
    of a hash-random key until the source's budget (its target without fraction) is reached to the word; the document
    at the cut gives its first words only.  Null and empty texts have size 0 and give 0; a null source is a source of
    its own; rows of one id are mixed one by one; an empty table gives an empty one.
    """
    return _mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words with the blanks between them; cuts lie where a word ends."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each row it takes words of, with ``text`` written out as often as it is taken, epochs on lines of
    their own, and cut to the word where the budget ends; ``n_chars`` is of that text, ``taken`` its words.

    Rows are carried through the prefix sums, so that repeated rows and rows of one id are mixed one by one.  Null and empty
    texts give nothing and go.
    """
    d = _mixed(docs, "text", "lang").where("taken > 0")
    text = F.col("rest.text")
    whole = F.array_repeat(text, F.col("epochs").cast("int"))
    rest = F.when(F.col("part") == F.col("size"), text).when(F.col("part") > 0, first_words(text, F.col("part")))
    written = F.array_join(F.concat(whole, F.array(rest)), "\n")  # nulls are left out
    d = d.select("doc_id", written.alias("text"), "rest.lang", "source", "size", "taken")
    return d.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), "size", "taken")


_SIZED = r"""
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM per),
weighed AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS weight FROM ranked),
levels AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
  coalesce(sum(source_size * 2) OVER before, 0)::DOUBLE AS caps_before,
  (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS weights_left FROM weighed
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fitted AS (SELECT *, (1.5::DOUBLE * total - caps_before) / weights_left AS level FROM levels),
common AS (SELECT min_by(level, (caps_before, rank)) AS level FROM fitted WHERE level <= 2.0::DOUBLE * source_size / weight),
targets AS (SELECT f.source, f.source_size, CASE WHEN c.level IS NULL THEN 2.0::DOUBLE * f.source_size
            ELSE least(2.0::DOUBLE * f.source_size, c.level * f.weight) END AS target FROM fitted f, common c),
placed AS (SELECT s.*, t.source_size, t.target,
  coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""
OP9_SQL = f"""WITH {_SIZED}
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken,
  epochs::BIGINT AS epochs FROM placed"""
