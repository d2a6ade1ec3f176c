"""Corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``run`` writes each result as Parquet in the cluster's shared checkpoint
folder and rereads it as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import common, op2_secrets, op4_dedup, op8_quality, op9_simhash, op10_packing

STAGES = [
    ("quality", op8_quality.stage),
    ("near_duplicates", op9_simhash.stage),
    ("repeated_passages", op4_dedup.stage),
    ("secrets", op2_secrets.stage),
    ("packing", op10_packing.stage),
]

#: The stages rest on a fitted model, fingerprints and a tokenizer, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
