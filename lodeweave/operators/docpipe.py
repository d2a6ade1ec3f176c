"""Document pipelines (lists of ``$`` stages) compiled to DataFrame operations."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import pattern


class PipelineError(ValueError):
    """A stage or an operator that isn't supported, or that writes."""


WRITES = ("$out", "$merge")


def _path(df: DataFrame, path: str) -> Column:
    head, *rest = path.split(".")
    if head not in df.columns:
        return F.lit(None)
    c, kind = F.col(f"`{head}`"), df.schema[head].dataType
    for part in rest:
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                return F.lit(None)
            c, kind = c[part], kind[part].dataType
        elif isinstance(kind, T.MapType):
            c, kind = F.try_element_at(c, F.lit(part)), kind.valueType
        elif isinstance(kind, T.ArrayType):
            c, kind = (F.try_element_at(c, F.lit(int(part) + 1)), kind.elementType) if part.isdigit() else (F.transform(c, lambda x, p=part: x[p]), kind)
        else:
            c, kind = F.get_json_object(c.cast("string"), f"$.{part}"), T.StringType()
    return c


_TWO = {"$subtract": lambda a, b: a - b, "$divide": lambda a, b: F.try_divide(a, b), "$mod": lambda a, b: a % b, "$eq": lambda a, b: a == b, "$ne": lambda a, b: a != b, "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$split": lambda a, b: F.split(a, F.concat(F.lit(r"\Q"), b, F.lit(r"\E")), -1)}
_ONE = {"$toInt": lambda a: a.try_cast("int"), "$toLong": lambda a: a.try_cast("bigint"), "$toDouble": lambda a: a.try_cast("double"), "$toString": lambda a: a.cast("string"), "$toLower": F.lower, "$toUpper": F.upper, "$size": F.size, "$year": F.year, "$month": F.month, "$abs": F.abs, "$floor": F.floor, "$ceil": F.ceil, "$trim": F.trim, "$strLenCP": F.length}


def value(df: DataFrame, e: object) -> Column:
    """An expression: ``"$path"``, ``{"$operator": ...}`` or a literal."""
    if isinstance(e, str) and e.startswith("$"):
        return _path(df, e[1:])
    if isinstance(e, dict) and len(e) == 1 and next(iter(e)).startswith("$"):
        (name, arg), = e.items()
        args = [value(df, x) for x in arg] if isinstance(arg, list) else [value(df, arg)]
        if name in _ONE:
            return _ONE[name](args[0])
        if name in _TWO:
            return _TWO[name](*args)
        if name == "$literal":
            return F.lit(arg)
        if name == "$arrayElemAt":
            index = arg[1]
            return F.try_element_at(args[0], F.lit(index + 1 if index >= 0 else index))
        if name in ("$add", "$multiply"):
            return reduce((lambda a, b: a + b) if name == "$add" else (lambda a, b: a * b), args)
        if name == "$concat":
            return F.concat(*(a.cast("string") for a in args))
        if name == "$ifNull":
            return F.coalesce(*args)
        if name == "$cond":
            test, yes, no = (value(df, arg[k]) for k in ("if", "then", "else")) if isinstance(arg, dict) else args
            return F.when(test, yes).otherwise(no)
        if name in ("$and", "$or"):
            return reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), args)
        if name == "$not":
            return ~args[0]
        raise PipelineError(f"operator {name} isn't supported")
    if isinstance(e, dict):
        return F.struct(*(value(df, v).alias(k) for k, v in e.items()))
    if isinstance(e, list):
        return F.array(*(value(df, x) for x in e))
    return F.lit(e)


def condition(df: DataFrame, test: dict) -> Column:
    """A ``$match`` document."""
    parts = []
    for key, want in test.items():
        if key in ("$and", "$or", "$nor"):
            every = [condition(df, x) for x in want]
            joined = reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), every)
            parts.append(~joined if key == "$nor" else joined)
            continue
        if key == "$expr":
            parts.append(F.coalesce(value(df, want), F.lit(False)))
            continue
        c = _path(df, key)
        if not isinstance(want, dict) or not any(k.startswith("$") for k in want):
            parts.append(c.isNull() if want is None else F.coalesce(c == F.lit(want), F.lit(False)))
            continue
        flags = want.get("$options", "")
        for name, x in want.items():
            if name == "$options":
                continue
            if name == "$regex":
                hit = c.cast("string").rlike(pattern(x, "i" in flags, "s" in flags))
            elif name == "$exists":
                hit = c.isNotNull() if x else c.isNull()
            elif name == "$ne":
                hit = c.isNotNull() if x is None else ~F.coalesce(c == F.lit(x), F.lit(False))
            elif name in ("$in", "$nin"):
                hit = F.coalesce(c.isin(x), F.lit(False))
                hit = ~hit if name == "$nin" else hit
            elif name == "$eq":
                hit = c.isNull() if x is None else c == F.lit(x)
            elif name in _TWO:
                hit = _TWO[name](c, F.lit(x))
            else:
                raise PipelineError(f"operator {name} isn't supported")
            parts.append(F.coalesce(hit, F.lit(False)))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _accumulate(df: DataFrame, name: str, arg: object) -> Column:
    if name == "$sum" and isinstance(arg, (int, float)):
        return F.sum(F.lit(arg))
    if name == "$count":
        return F.count("*")
    c = value(df, arg)
    simple = {"$sum": lambda x: F.coalesce(F.sum(x), F.lit(0)), "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$last": F.last, "$push": F.collect_list, "$addToSet": F.collect_set, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}
    if name not in simple:
        raise PipelineError(f"accumulator {name} isn't supported")
    return simple[name](c)


def run(df: DataFrame, stages: list[dict] | str) -> DataFrame:
    for stage in json.loads(stages) if isinstance(stages, str) else stages:
        (name, arg), = stage.items()
        if name in WRITES:
            raise PipelineError(f"{name} writes")
        if name == "$match":
            df = df.where(condition(df, arg))
        elif name == "$limit":
            df = df.limit(arg)
        elif name == "$skip":
            df = df.offset(arg)
        elif name == "$sample":
            df = df.orderBy(F.rand()).limit(arg["size"])
        elif name == "$sort":
            df = df.orderBy(*(_path(df, k).asc_nulls_first() if d > 0 else _path(df, k).desc_nulls_last() for k, d in arg.items()))
        elif name == "$count":
            df = df.agg(F.count("*").alias(arg))
        elif name in ("$addFields", "$set"):
            df = df.withColumns({k: value(df, v) for k, v in arg.items()})
        elif name == "$unset":
            df = df.drop(*([arg] if isinstance(arg, str) else arg))
        elif name == "$project":
            out = {k: v for k, v in arg.items() if v not in (0, False)}
            if not out:
                df = df.drop(*arg)
            else:
                if "_id" in df.columns and arg.get("_id", 1) not in (0, False):
                    out = {"_id": 1} | out
                df = df.select(*((_path(df, k) if v in (1, True) else value(df, v)).alias(k.replace(".", "_")) for k, v in out.items()))
        elif name == "$unwind":
            path = (arg if isinstance(arg, str) else arg["path"]).removeprefix("$")
            keep = isinstance(arg, dict) and arg.get("preserveNullAndEmptyArrays")
            df = df.withColumn(path, (F.explode_outer if keep else F.explode)(_path(df, path)))
        elif name == "$group":
            key = arg["_id"]
            aggregates = [_accumulate(df, *next(iter(v.items()))).alias(k) for k, v in arg.items() if k != "_id"]
            grouped = df.groupBy(value(df, key).alias("_id")) if key is not None else df.groupBy()
            if not aggregates:
                df = grouped.count().drop("count")
            else:
                df = grouped.agg(*aggregates)
            if key is None:
                df = df.select(F.lit(None).cast("string").alias("_id"), *df.columns)
        else:
            raise PipelineError(f"stage {name} isn't supported")
    return df
