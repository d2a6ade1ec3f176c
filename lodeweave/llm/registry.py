"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_toxicity, op2_secrets, op3_topk, op4_dedup, op5_bpe, op6_licenses, op7_flac, op8_quality, op9_simhash, op10_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity.query,
    "op2_secrets": op2_secrets.query,
    "op3_topk": op3_topk.query,
    "op4_dedup": op4_dedup.query,
    "op5_bpe": op5_bpe.query,
    "op6_licenses": op6_licenses.query,
    "op7_flac": op7_flac.query,
    "op8_quality": op8_quality.query,
    "op9_simhash": op9_simhash.query,
    "op10_packing": op10_packing.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secrets": op2_secrets.ORACLE_SQL,
    "op3_topk": op3_topk.ORACLE_SQL,
    "op4_dedup": op4_dedup.ORACLE_SQL,
    "op6_licenses": op6_licenses.ORACLE_SQL,
}
