"""Repeated ingest: files that arrive are merged into a versioned store, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from procura.operators import upsert


def newest_per_id(batch: DataFrame, order: str) -> DataFrame:
    """The newest row an id; of equally new ones that of the smallest hash over all columns, the same in each run."""
    w = W.partitionBy("id").orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*[F.to_json(F.struct(c)) for c in batch.columns]))
    return batch.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def run_available(
    spark: SparkSession, arriving: str, schema: str, store: str, checkpoint: str, order: str = "last_seen_at", keep_if_null: tuple[str, ...] = ("national_id",)
) -> StreamingQuery:
    """Merges all Parquet files not seen before into ``store/version=N``; running again without new files changes nothing.

    Each batch reads one version and writes the next; a batch that is tried again overwrites its own version, so that
    a lost driver or executor leaves the store as if it had run once.
    """
    stream = spark.readStream.schema(schema).parquet(arriving)
    cols = [c for c in stream.columns if c != "id"]

    def apply(batch: DataFrame, n: int) -> None:
        new = newest_per_id(batch, order)
        if n:
            old = spark.read.schema(schema).parquet(f"{store}/version={n - 1}")
            new = upsert.merge(new, old, cols, keep_if_null)
        new.write.mode("overwrite").parquet(f"{store}/version={n}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
