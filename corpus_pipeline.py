"""Cleaning and encoding of a corpus in five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annolake.llm import decontaminate, lines, neardup, pieces, toxicity
from annolake.llm.common import written

#: (name, function of session, documents and tables' folder); all but the last return documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", lines.stage),
    ("minhash_near_dedup", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("piece_encoding", pieces.stage),
]

#: A trained classifier has no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
