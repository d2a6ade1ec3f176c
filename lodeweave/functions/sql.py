"""SQL functions that callers of other dialects expect, registered in a session."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Name, parameters and body of each function that is an expression.
EXPRESSIONS = {
    "normalize_text": ("s STRING", "STRING", r"regexp_replace(regexp_replace(lower(s), r'[^\x00-\x7f]', ''), r'\s+', '')"),
    "regexp_replace_g": ("s STRING, p STRING, r STRING, flags STRING", "STRING", "regexp_replace(s, concat(case when flags like '%i%' then '(?iu)' else '' end, p), r)"),
    "strftime_unix": ("fmt STRING, seconds BIGINT", "STRING", "case fmt when '%Y' then date_format(timestamp_seconds(seconds), 'yyyy') when '%m' then date_format(timestamp_seconds(seconds), 'MM') when '%d' then date_format(timestamp_seconds(seconds), 'dd') when '%s' then cast(seconds as string) else date_format(timestamp_seconds(seconds), 'yyyy-MM-dd') end"),
    "try_strptime_date": ("s STRING, fmt STRING", "DATE", "cast(try_to_timestamp(s, fmt) as date)"),
    "json_extract_text": ("j STRING, k STRING", "STRING", "get_json_object(j, concat('$.', k))"),
}


def fold_text(s: pd.Series) -> pd.Series:
    """Lower case, accents taken off, other characters beyond ASCII dropped, white space removed."""
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        plain = unicodedata.normalize("NFKD", x.lower()).encode("ascii", "ignore").decode()
        return "".join(plain.split())

    return s.map(one, na_action="ignore")


def register(spark: SparkSession) -> None:
    for name, (parameters, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("normalize_text_fold", F.pandas_udf(fold_text, "string"))
