"""What the training-data operators share: words, row keys, lineage cuts, components.

Null text counts as empty text everywhere.  Rows are never dropped because an id is null or repeated.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without the six ASCII blanks; ``bytes.split()`` cuts at exactly the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words as a long, 0 for null; runs inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    """Text as bytes for the Python side, so that no batch is decoded twice."""
    return F.coalesce(text, F.lit("")).cast("binary")


def text_key(text: Column) -> Column:
    """128 bits for a text (null as empty), by which equal texts are known without being compared."""
    return F.unhex(F.md5(utf8(text)))


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a few rows.

    Spark ends a batch at ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB) or at one row; what a worker makes of a
    batch is bounded by slicing it here, not by settings of the session.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "procura-checkpoints")
    return base


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, survives lost executors, is column-pruned when read, and costs
    compressed columns instead of serialized rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spent(*tables: DataFrame) -> None:
    """Remove the files of tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def merged(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """The join of two tables that both grow with the corpus, by sorting.

    Compressed columns of numbers and hashes look small enough to broadcast long after they are too large for the driver,
    which builds such a table in its own heap, several at once.
    """
    return a.join(b.hint("merge"), on, how)


def fingerprint_of(df: DataFrame, *cols: str) -> tuple[int, int]:
    """Row count and an order-free checksum; one small aggregation."""
    h = F.xxhash64(*cols)
    r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0))).first()
    return int(r[0]), int(r[1])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star steps, each an aggregation and an equi-join, until nothing changes;
    no component or link ever reaches the driver.  Every step's table is written to the shared folder.
    """
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = fingerprint_of(e, "u", "v")
    while before[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = merged(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        spent(old)
        now = fingerprint_of(e, "u", "v")
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
