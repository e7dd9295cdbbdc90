"""Documents to a training mix: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from procura.llm import decontam, line_dedup, mixing, quality_rules, simhash
from procura.llm.common import shared_dir

STAGES = [
    ("quality rules", quality_rules.stage),
    ("line dedup", line_dedup.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontam.stage),
    ("mixing sources to target weights", mixing.stage),
]
#: XXH64 and Golay codes are not in DuckDB: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words each document gives to the mix: ``doc_id, text, lang, source, n_chars, size, taken``."""
    base = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
    return docs
