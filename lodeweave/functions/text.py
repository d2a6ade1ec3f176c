"""Columns with the text and number semantics that the transforms share.

``as_text`` reads null, zero, false and the empty string as the empty string;
``strip`` takes off white space of any kind, where ``trim`` takes off blanks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PatternError(ValueError):
    """A pattern that has no equivalent in the JVM's regular expressions."""


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def column(df: DataFrame, name: str) -> Column:
    """The column, or null where the table has none of that name."""
    return F.col(quoted(name)) if has(df, name) else F.lit(None).cast("string")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_text(df: DataFrame, name: str) -> Column:
    if not has(df, name):
        return F.lit("")
    c, kind = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").otherwise("")
    if isinstance(kind, T.NumericType):
        return F.when(c.isNull() | (c == 0), "").otherwise(c.cast("string"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def as_string(df: DataFrame, name: str) -> Column:
    """The value's text, null for null; booleans as True and False."""
    c = column(df, name)
    if has(df, name) and isinstance(df.schema[name].dataType, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast("string")


def as_number(df: DataFrame, name: str) -> Column:
    """The value as a double, null where it isn't one."""
    c = column(df, name)
    if has(df, name) and isinstance(df.schema[name].dataType, T.StringType):
        return F.when(strip(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.expr(f"try_cast({STRIP.format(quoted(name))} as double)"))
    return c.cast("double") if not has(df, name) or isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)) else F.lit(None).cast("double")


STRIP = r"regexp_replace({}, r'^(?U:\s+)|(?U:\s+)$', '')"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U:\s+)|(?U:\s+)$", "")


def pattern(source: str, ignore_case: bool = False, dotall: bool = False) -> str:
    """A Python pattern in the JVM's syntax, with Unicode classes."""
    compiled = re.compile(source)  # a bad pattern is the caller's error, here and not in a task
    if re.search(r"\(\?P=|\(\?\(", source):
        raise PatternError(f"named back references and conditionals aren't supported: {source}")
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'u')}>", source).replace(r"\Z", r"\z")
    del compiled
    return f"(?U{'i' if ignore_case else ''}{'u' if ignore_case else ''}{'s' if dotall else ''})" + out


def replacement(source: str) -> str:
    """A Python replacement in the JVM's syntax."""
    out = source.replace("$", r"\$")
    return re.sub(r"\\g<(\w+)>|\\(\d+)", lambda m: "$" + (m[1] or m[2]), out)


def groups(source: str) -> int:
    return re.compile(source).groups
