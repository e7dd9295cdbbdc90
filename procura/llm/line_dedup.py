"""Line dedup with content-defined chunks, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm.common import table, text_key

DIVISOR = 2  # a boundary follows a line in one of two places: chunks have two lines on average
MOD = 1_000_003


def chunked(docs: DataFrame, *rest: str) -> DataFrame:
    """``doc_id, th, rest, lines, ends``: chunk ``i`` is the lines from ``ends[i - 1]`` to ``ends[i]``; ``th`` is 128 bits of the text.

    A chunk ends where the rolling hash of two line hashes is 0 modulo DIVISOR, and with the text.  A boundary depends
    on two neighbouring lines only, so that lines put in or taken out shift no boundary further on.
    """
    keep = ["doc_id", "th", "rest"]
    d = docs.select("doc_id", F.struct(F.lit(0).alias("_"), *rest).alias("rest"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", text_key(F.col("text")).alias("th"), "rest", F.split("text", "\n", -1).alias("lines"))
    hashes = F.transform("lines", lambda x: F.pmod(F.xxhash64(x), F.lit(MOD)))
    d = _barrier(d.select(*keep, "lines", hashes.alias("hashes")), keep, "lines", "hashes")

    def ends_at(i: Column) -> Column:
        before = F.coalesce(F.get("hashes", i - 2), F.lit(0))
        return (i == F.size("lines")) | (F.pmod(before * 31 + F.get("hashes", i - 1), F.lit(MOD)) % DIVISOR == 0)

    ends = F.filter(F.sequence(F.lit(1), F.size("lines")), ends_at)
    return _barrier(d.select(*keep, "lines", ends.alias("ends")), keep, "lines", "ends")


def _barrier(d: DataFrame, keep: list[str], *arrays: str) -> DataFrame:
    """The same rows out of a generator, into which no later expression is merged.

    Without it the optimizer may put an array's expression into a lambda and evaluate it anew for each element.
    """
    return d.select(*keep, F.inline(F.array(F.struct(*arrays))))


def _start(i: Column) -> Column:
    return F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1))


def removals(chunks: DataFrame) -> DataFrame:
    """``doc_id, th, gone, first``: for documents with repeated chunks, the ordinals of those to remove and of those that
    stay as the first of their kind.

    What is compared is a chunk with the line after it, so that a chunk of one line counts too, and every repeat has two
    lines or more.  They are counted by their bytes, with partial counts before the shuffle; a 128-bit hash then stands
    for the bytes, and a hash with two different texts removes nothing.  The join with the places is followed by an
    exchange alone, so that a chunk which a third of all documents have can be split.
    """
    ordinal = lambda e, i: F.struct(
        i.alias("ord"),
        F.least(e + 1, F.size("lines")) - _start(i),
        F.array_join(F.slice("lines", _start(i) + 1, F.least(e + 1, F.size("lines")) - _start(i)), "\n"),
    )
    many = chunks.select("doc_id", "th", F.inline(F.transform("ends", ordinal))).toDF("doc_id", "th", "ord", "n", "text").where("n > 1")
    hashed = many.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(7), "text"))
    by_text = hashed.groupBy("h1", "h2", "text").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("first"))
    repeated = (
        by_text.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("c").alias("c"), F.min("first").alias("first"))
        .where("texts = 1 AND c > 1")
        .select("h1", "h2", "first")
    )
    places = hashed.select("doc_id", "th", "ord", "h1", "h2").join(repeated, ["h1", "h2"])
    own = F.col("doc_id").eqNullSafe(F.col("first")).alias("own")
    in_doc = places.select("doc_id", "th", F.struct("h1", "h2", "ord", own).alias("p")).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("p")).alias("p"))
    # Sorted by chunk, then place: the first of a chunk in its first document stays.
    again = lambda x, i: (i > 0) & (F.get("p", i - 1)["h1"] == x["h1"]) & (F.get("p", i - 1)["h2"] == x["h2"])
    stays = lambda x, i: x["own"] & ~F.coalesce(again(x, i), F.lit(False))
    in_doc = _barrier(in_doc, ["doc_id", "th"], "p")
    ords = lambda xs: F.transform(xs, lambda x: x["ord"])
    return in_doc.select(
        "doc_id", "th", ords(F.filter("p", lambda x, i: ~stays(x, i))).alias("gone"), ords(F.filter("p", stays)).alias("first")
    ).where(F.size("gone") > 0)


def dedup_lines(docs: DataFrame, *rest: str) -> DataFrame:
    """Documents without the multi-line chunks that the corpus repeats; the first occurrence stays.

    First is the smallest doc_id (null last), then the place in the text; rows of one id count as one document there.
    A repeat is a chunk with the line after it; that line goes too, unless it begins a chunk that stays as the first of
    its own kind.  Returns a row for each row: ``doc_id, text`` (cleaned), ``rest`` (struct of the columns asked for),
    ``n_lines, n_chunks, n_removed_chunks, n_removed_lines``.  Null and empty texts are one empty line and come back
    empty; a text of one line stays.  Other columns are ignored.  An empty table gives an empty one.
    """
    chunks = chunked(docs, *rest)
    c, g = chunks.alias("c"), removals(chunked(docs)).alias("g")
    on = F.col("c.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("c.th") == F.col("g.th"))
    keep = ["doc_id", "rest"]
    none = F.array().cast("array<int>")
    joined = c.join(g, on, "left").select("c.doc_id", "rest", "lines", "ends", F.coalesce("gone", none).alias("gone"), F.coalesce("first", none).alias("first"))
    places = F.sequence(F.lit(0), F.size("ends") - 1)
    # All by hashing: in proportion to the chunks, also in a text of a million lines.
    after = F.array_except(F.array_except(F.transform("gone", lambda x: x + 1), F.col("gone")), F.col("first"))
    left = joined.select(*keep, "lines", "ends", "gone", F.array_except(places, "gone").alias("kept"), after.alias("after"))
    left = _barrier(left, keep, "lines", "ends", "gone", "kept", "after")
    whole, cut = F.array_except("kept", "after"), F.array_intersect("kept", "after")

    def part(skip: int):
        def of(i: Column) -> Column:
            n = F.get("ends", i) - _start(i) - skip
            return F.struct(i.alias("ord"), n.alias("n"), F.array_join(F.slice("lines", _start(i) + 1 + skip, F.greatest(n, F.lit(0))), "\n").alias("text"))

        return of

    parts = F.array_sort(F.filter(F.concat(F.transform(whole, part(0)), F.transform(cut, part(1))), lambda x: x["n"] > 0))
    done = left.select(*keep, F.size("lines").alias("n_lines"), F.size("ends").alias("n"), F.size("gone").alias("n_gone"), parts.alias("parts"))
    done = _barrier(done, keep, "n_lines", "n", "n_gone", "parts")
    return done.select(
        "doc_id",
        F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"),
        "rest",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n").cast("long").alias("n_chunks"),
        F.col("n_gone").cast("long").alias("n_removed_chunks"),
        (F.col("n_lines") - F.aggregate("parts", F.lit(0), lambda a, x: a + x["n"])).cast("long").alias("n_removed_lines"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).drop("rest")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cleaned documents; those that lost every line they had go.

    Null and empty texts are one line, which is never removed, and stay; repeated rows each lose the same lines.
    """
    d = dedup_lines(docs, "lang", "source").where("n_removed_lines < n_lines")
    return d.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars"))
