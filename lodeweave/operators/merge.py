"""Federated join of named sub-query results on the text of their keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..functions.text import as_string, quoted


class MergeError(ValueError):
    """A join that names keys or columns that aren't there."""


@dataclass(frozen=True)
class Pair:
    """``left_key.left_column = right_key.right_column``, the left side brought to ``transform``'s form, or ``both``."""

    left_key: str
    left_column: str
    right_key: str
    right_column: str
    transform: str | None = None
    both: bool = False

    @classmethod
    def parse(cls, left: str, right: str, transform: str | None = None) -> Pair:
        if "." not in left or "." not in right:
            raise MergeError(f"a join reference needs key.column: {left!r}, {right!r}")
        return cls(*left.split(".", 1), *right.split(".", 1), transform)


def _comparable(left: DataFrame, a: str, right: DataFrame, b: str, transform: str | None, both: bool = False) -> tuple[Column, Column]:
    """The two sides of a key. Columns of one exact type need no texts to compare."""
    if transform is None and left.schema[a].dataType == right.schema[b].dataType and isinstance(left.schema[a].dataType, (T.IntegralType, T.StringType, T.DateType)):
        return F.col(quoted(a)), F.col(quoted(b))
    right_text = as_string(right, b)
    return keys.apply(transform, as_string(left, a)), keys.apply(transform, right_text) if both else right_text


def _name(key: str, column: str, first: str) -> str:
    return column if key == first else f"{key}__{column}"


def merge(frames: dict[str, DataFrame], pairs: list[Pair], how: str = "inner", pair_semantics: str = "and", empty_right: str = "join") -> DataFrame:
    """Left-deep joins of ``frames`` in the order of ``pairs``; a right side's columns become ``key__column``.

    Several pairs of the same two keys are one composite key, or with
    ``pair_semantics="chain"`` joins one after the other, of which the last
    gives the right columns. With ``empty_right="passthrough"`` an empty right
    side is left out. Without pairs the first frame is the result.
    """
    first = next(iter(frames))
    merged, joined = frames[first], {first}
    for p in pairs:
        for key in (p.left_key, p.right_key):
            if key not in frames:
                raise MergeError(f"unknown key {key!r}")
    groups: list[list[Pair]] = []
    for p in pairs:
        if pair_semantics == "and" and groups and (groups[-1][0].left_key, groups[-1][0].right_key) == (p.left_key, p.right_key):
            groups[-1].append(p)
        else:
            groups.append([p])
    for group in groups:
        left_key, right_key = group[0].left_key, group[0].right_key
        if left_key not in joined:
            raise MergeError(f"{left_key!r} isn't part of the join yet")
        right = frames[right_key]
        if empty_right == "passthrough" and right.isEmpty():
            continue
        renamed = right.select(*(F.col(quoted(c)).alias(f"{right_key}__{c}") for c in right.columns))
        merged = merged.select(*(F.col(quoted(c)) for c in merged.columns if c not in renamed.columns or right_key == left_key))
        on = None
        for p in group:
            a, b = _name(left_key, p.left_column, first), f"{right_key}__{p.right_column}"
            if a not in merged.columns or b not in renamed.columns:
                raise MergeError(f"no such column: {p.left_key}.{p.left_column} or {p.right_key}.{p.right_column}")
            x, y = _comparable(merged, a, renamed, b, p.transform, p.both)
            on = (x == y) if on is None else on & (x == y)
        merged = merged.join(renamed, on, how)
        joined.add(right_key)
    return merged
