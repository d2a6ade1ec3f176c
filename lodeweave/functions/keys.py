"""The key grammar: named ways to bring join keys of two sources to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def _drop(n: int):
    return lambda c: F.when(F.length(c) > n, F.substring(c, n + 1, 1 << 30)).otherwise(c)


def _zfill(n: int):
    def fill(c: Column) -> Column:
        d = F.regexp_replace(_digits(c), "^0+(?=.)", "")
        d = F.when(d == "", "0").otherwise(d)
        return F.when(F.length(d) >= n, d).otherwise(F.lpad(d, n, "0"))

    return fill


#: In the order in which ties are broken.
GRAMMAR = {
    "identity": strip,
    "lowercase": lambda c: F.lower(strip(c)),
    "extract_digits": _digits,
    "strip_prefix_3": _drop(3),
    "strip_prefix_4": _drop(4),
    "strip_prefix_5": _drop(5),
    "zfill_5": _zfill(5),
    "zfill_7": _zfill(7),
    "remove_separators": lambda c: F.regexp_replace(c, r"(?U)[-_\s]", ""),
}

#: The same as SQL text, for display.
SQL = {
    "identity": "trim({0})",
    "lowercase": "lower(trim({0}))",
    "extract_digits": r"regexp_replace({0}, '[^0-9]', '')",
    "strip_prefix_3": "substring({0}, 4)",
    "strip_prefix_4": "substring({0}, 5)",
    "strip_prefix_5": "substring({0}, 6)",
    "zfill_5": r"lpad(regexp_replace({0}, '[^0-9]', ''), 5, '0')",
    "zfill_7": r"lpad(regexp_replace({0}, '[^0-9]', ''), 7, '0')",
    "remove_separators": r"regexp_replace({0}, '[-_ ]', '')",
    "cast_int": "cast({0} as bigint)",
}


def transform_sql(name: str | None, column: str) -> str:
    return SQL.get(name or "identity", "{0}").format(column)


def apply(name: str | None, c: Column) -> Column:
    """A key in the form ``name`` gives; without a name, its text as it is."""
    return c if name is None else GRAMMAR[name](c)
