"""Post-query transforms: each takes a DataFrame and a step's options and returns a DataFrame.

``apply`` runs a list of steps, ``{"op": name, ...}``, as one lazy plan made of
column expressions. A column that is missing reads as null. Order matters only
where a step says so; ``order_by`` in a grouping step says which row's other
columns are carried.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_number, as_string, as_text, column, groups, has, pattern, quoted, replacement, strip

OPS: dict[str, Callable[..., DataFrame]] = {}


class UnknownOperator(ValueError):
    """A step whose ``op`` isn't known."""


def op(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    OPS[f.__name__.removesuffix("_")] = f
    return f


def apply(df: DataFrame, steps: Sequence[dict], strict: bool = True) -> DataFrame:
    for step in steps:
        options = dict(step)
        name = options.pop("op", None)
        if name in OPS:
            df = OPS[name](df, **options)
        elif strict:
            raise UnknownOperator(f"unknown op {name!r}")
    return df


def _put(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# -- numbers and text ---------------------------------------------------------

# The named patterns of extract_number.
METRICS = {
    "stars": [r"([\d,]+)\s+stars?\b", r"stars?\s+count\s+of\s+([\d,]+)"],
    "forks": [r"([\d,]+)\s+forks?\b", r"forks?\s+count\s+of\s+([\d,]+)", r"forked\s+([\d,]+)\s+times"],
    "issues": [r"([\d,]+)\s+(?:open\s+)?issues?\b", r"issues?\s+count\s+of\s+([\d,]+)"],
}


@op
def extract_number(df: DataFrame, column: str, metric: str | None = None, patterns: Sequence[str] | None = None, output: str | None = None) -> DataFrame:
    """The first pattern whose first group is a whole number, commas aside."""
    text = as_text(df, column)
    tries = []
    for p in patterns or METRICS.get(metric or "", []):
        found = F.regexp_replace(F.regexp_extract(text, pattern(p, ignore_case=True), min(1, groups(p))), r"[,\s]", "")
        tries.append(F.when(found.rlike(r"^[+-]?\d{1,18}$"), found).try_cast("bigint"))
    return _put(df, output or metric or column, F.coalesce(*tries) if tries else F.lit(None).cast("bigint"))


@op
def cast_number(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """A whole number from text, commas and white space aside; zero from a number column reads as null."""
    bare = F.regexp_replace(as_text(df, column), r"(?U)[,\s]", "")
    return _put(df, output or column, F.when(bare.rlike(r"^[+-]?\d+$"), bare).try_cast("bigint"))


@op
def project_name_from_text(df: DataFrame, column: str, output: str = "project_name") -> DataFrame:
    return _put(df, output, F.nullif(F.regexp_extract(as_text(df, column), r"(?Uiu)project\s+([^\s]+)\s+on\s+github", 1), F.lit("")))


@op
def round_down(df: DataFrame, column: str, to: int = 10, output: str | None = None) -> DataFrame:
    """The multiple of ``to`` at or below the value's whole part; null reads as zero, text that is no number gives null."""
    raw = F.col(quoted(column)) if has(df, column) else F.lit(None)
    whole = F.when(raw.isNull() | (as_text(df, column) == ""), F.lit(0.0)).otherwise(as_number(df, column)).try_cast("bigint")
    return _put(df, output or column, whole - F.pmod(whole, F.lit(to)))


@op
def regex_extract(df: DataFrame, column: str, pattern: str, output: str | None = None, group: int = 1) -> DataFrame:
    from ..functions.text import pattern as jvm

    text, p = as_text(df, column), jvm(pattern, dotall=True)
    most = groups(pattern)
    whole = F.regexp_extract(text, p, 0)
    value = F.nullif(F.regexp_extract(text, p, group), F.lit("")) if 0 < group <= most else whole
    return _put(df, output or column, F.when(text.rlike(p), value))


@op
def string_map(df: DataFrame, column: str, pattern: str, replacement: str = "", output: str | None = None, ignore_case: bool = True) -> DataFrame:
    from ..functions.text import pattern as jvm
    from ..functions.text import replacement as jvm_replacement

    return _put(df, output or column, strip(F.regexp_replace(as_text(df, column), F.lit(jvm(pattern, ignore_case)), F.lit(jvm_replacement(replacement)))))


@op
def string_filter(df: DataFrame, column: str, pattern: str, mode: str = "keep", ignore_case: bool = False) -> DataFrame:
    from ..functions.text import pattern as jvm

    hit = as_text(df, column).rlike(jvm(pattern, ignore_case))
    return df.where(hit if mode == "keep" else ~hit if mode == "drop" else F.lit(False))


@op
def text_extract_list(df: DataFrame, column: str, output: str | None = None, min_items: int = 2) -> DataFrame:
    """The capitalised comma list with most items; the first of equals."""
    item = r"[A-Z][^,\.\n!?;:]+"
    found = F.regexp_extract_all(as_text(df, column), F.lit(rf"(?U){item}(?:,\s*{item})*"), F.lit(0))
    size = lambda x: F.size(F.filter(F.transform(F.split(x, ",", -1), strip), lambda y: y != ""))
    best = F.array_max(F.transform(found, lambda x, i: F.struct(size(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return _put(df, output or column, F.when(best["n"] >= min_items, strip(best["x"])))


@op
def string_after_last(df: DataFrame, column: str, separator: str, output: str | None = None) -> DataFrame:
    text = as_text(df, column)
    return _put(df, output or column, F.when(F.contains(text, F.lit(separator)), strip(F.substring_index(text, separator, -1))))


@op
def string_after_any_last(df: DataFrame, column: str, separators: Sequence[str], output: str | None = None) -> DataFrame:
    """What follows the separator that begins furthest to the right; the first listed of equals."""
    text = as_text(df, column)
    ends = []
    for k, s in enumerate(separators):
        at = F.when(F.contains(text, F.lit(s)), F.length(text) - F.length(F.substring_index(text, s, -1)) - len(s) + 1).otherwise(0)
        ends.append(F.struct(at.alias("at"), F.lit(-k).alias("k"), F.lit(len(s)).alias("n")))
    best = F.array_max(F.array(*ends))
    return _put(df, output or column, F.when(best["at"] > 0, strip(F.substring(text, best["at"] + best["n"], F.length(text)))))


@op
def string_before_first(df: DataFrame, column: str, separator: str, output: str | None = None) -> DataFrame:
    text = as_text(df, column)
    return _put(df, output or column, F.when(F.contains(text, F.lit(separator)), strip(F.substring_index(text, separator, 1))).otherwise(text))


@op
def string_strip_prefix(df: DataFrame, column: str, output: str | None = None, preset: str = "leading_digits") -> DataFrame:
    p = r"(?U)^.+?\s+-\s+" if preset == "before_dash" else r"(?U)^\d+[-.\s]+"
    return _put(df, output or column, strip(F.regexp_replace(as_text(df, column), p, "")))


@op
def string_drop_between(df: DataFrame, column: str, open: str = "(", close: str = ")", output: str | None = None) -> DataFrame:
    inner = "[^" + "".join("\\" + c if not c.isalnum() else c for c in close) + "]*"
    return _put(df, output or column, strip(F.regexp_replace(as_text(df, column), rf"\Q{open}\E{inner}\Q{close}\E", "")))


# -- order and filters --------------------------------------------------------


@op
def sort(df: DataFrame, column: str | None = None, by: str | None = None, direction: str = "desc") -> DataFrame:
    """Descending puts nulls first, ascending last."""
    name = column or by
    if not has(df, name):
        return df
    c = F.col(quoted(name))
    return df.orderBy(c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last())


@op
def top_n_with_ties(df: DataFrame, column: str, n: int = 5, direction: str = "desc") -> DataFrame:
    """Rows at or beyond the n-th value, without nulls.

    The n-th value is found by a top-n of one column, so no partition sees all rows.
    """
    if not has(df, column):
        return df.limit(0)
    c = F.col(quoted(column))
    order = c.desc() if direction == "desc" else c.asc()
    some = df.where(c.isNotNull())
    edge = some.select(c.alias("v")).orderBy(F.col("v").desc() if direction == "desc" else F.col("v").asc()).limit(n)
    edge = edge.agg((F.min("v") if direction == "desc" else F.max("v")).alias("__edge"))
    kept = some.join(F.broadcast(edge), c >= F.col("__edge") if direction == "desc" else c <= F.col("__edge"))  # one row
    return kept.drop("__edge").orderBy(order)


@op
def filter_(df: DataFrame, column: str, min: float | None = None, max: float | None = None, equals: object = None) -> DataFrame:
    """Nulls go; values that are no numbers pass ``min`` and ``max``; ``equals`` compares texts."""
    if not has(df, column):
        return df.limit(0)
    keep, number = F.col(quoted(column)).isNotNull(), as_number(df, column)
    if min is not None:
        keep &= F.coalesce((number >= min) & ~F.isnan(number) | F.isnan(number), F.lit(True))
    if max is not None:
        keep &= F.coalesce((number <= max) | F.isnan(number), F.lit(True))
    if equals is not None:
        keep &= as_string(df, column) == str(equals)
    return df.where(keep)


# -- nested values and dates --------------------------------------------------


@op
def json_array_extract(df: DataFrame, column: str, field: str | None = None, output: str | None = None) -> DataFrame:
    """Items of a list, or one field of each; of an object, the field. Text is parsed, and bad text is null."""
    if not has(df, column):
        return _put(df, output or column, F.lit(None).cast("array<string>"))
    c, kind = F.col(quoted(column)), df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if field and isinstance(inner, T.StructType):
            value = F.transform(c, lambda x: x[field]) if field in inner.names else F.transform(c, lambda x: F.lit(None).cast("string"))
        elif field and isinstance(inner, T.MapType):
            value = F.transform(c, lambda x: F.try_element_at(x, F.lit(field)))
        else:
            value = c
    elif isinstance(kind, (T.StructType, T.MapType)):
        value = F.array(c[field]) if field else F.array(c)
    else:
        text = c.cast("string")
        if field:
            parsed = F.try_parse_json(text)
            scalar = F.try_variant_get(parsed, "$." + field, "string")
            items = F.try_variant_get(parsed, "$", "array<variant>")
            value = F.coalesce(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$." + field, "string"), F.when(F.schema_of_variant(x).startswith("OBJECT"), F.lit(None).cast("string")).otherwise(F.try_variant_get(x, "$", "string")))), F.when(scalar.isNotNull(), F.array(scalar)))
        else:
            value = F.try_variant_get(F.try_parse_json(text), "$", "array<string>")
    return _put(df, output or column, value)


@op
def json_explode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """A row for each item, instead of the list; an empty list gives none, and what is no list stays one row."""
    out = output or column
    if not has(df, column):
        return df if has(df, out) else df.withColumn(out, F.lit(None).cast("string"))
    c, kind = F.col(quoted(column)), df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        items = F.when(c.isNull(), F.array(F.lit(None).cast(kind.elementType))).otherwise(c)
    else:
        items = F.array(c)
    others = [F.col(quoted(x)) for x in df.columns if x not in (column, out)]
    return df.select(*others, F.explode(items).alias(out))


@op
def string_explode(df: DataFrame, column: str, delimiter: str = ", ", output: str | None = None, strip: bool = True) -> DataFrame:
    """A row for each piece that isn't empty; null gives none."""
    from ..functions.text import strip as stripped

    out = output or column
    pieces = F.split(F.coalesce(as_string(df, column), F.lit("")), rf"\Q{delimiter}\E", -1)
    pieces = F.filter(F.transform(pieces, stripped) if strip else pieces, lambda x: x != "")
    others = [F.col(quoted(x)) for x in df.columns if x not in (column, out)]
    return df.select(*others, F.explode(pieces).alias(out))


#: strftime codes in the JVM's patterns.
_CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%B": "MMMM", "%b": "MMM", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%A": "EEEE", "%a": "EEE"}
#: Formats tried in order, with the shape that text must have.
_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$", None),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", "MMM d[,] yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2},? \d{4}$", "MMMM d[,] yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
]


@F.pandas_udf(T.DateType())
def _fuzzy_date(s: pd.Series) -> pd.Series:
    import datetime

    from dateutil import parser

    def one(x: str | None):
        if not x:
            return None
        try:
            return parser.parse(x, fuzzy=True, default=datetime.datetime(1, 1, 1)).date()
        except (ValueError, OverflowError):
            return None

    return s.map(one)


@op
def parse_date(df: DataFrame, column: str, output: str | None = None, output_format: str = "%Y-%m-%d", fuzzy: bool = True) -> DataFrame:
    """A date in ``output_format``: common forms first, with ``fuzzy`` whatever a date parser reads in the text, else the first year as its first day.

    Parts that the text lacks are those of January 1.
    """
    text = strip(as_text(df, column))
    native = []
    for shape, form in _FORMATS:
        hit = F.when(text.rlike(shape), text)
        native.append(F.to_date(F.try_to_timestamp(hit, F.lit(form)) if form else F.try_to_timestamp(hit)))
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    only_year = F.make_date(year.try_cast("int"), F.lit(1), F.lit(1))
    date = F.coalesce(*native)
    if fuzzy:
        # Only text with a digit that no common form has read goes to the parser.
        rest = F.when(date.isNull() & text.rlike(r"\d"), text)
        date = F.coalesce(date, _fuzzy_date(rest))
    form = output_format
    for code, jvm in _CODES.items():
        form = form.replace(code, jvm)
    return _put(df, output or column, F.date_format(F.coalesce(date, only_year), form))


# -- groups -------------------------------------------------------------------


def _carried(df: DataFrame, keys: list[str], output: str, order_by: str | Sequence[str] | None) -> tuple[DataFrame, list[Column], list[str]]:
    """Other columns come from a group's first row, by ``order_by`` or as read."""
    others = [c for c in df.columns if c not in keys and c != output]
    if not others:
        return df, [], []
    place = F.struct(*(F.col(quoted(c)) for c in _list(order_by))) if order_by else F.monotonically_increasing_id()
    carried = F.min_by(F.struct(*(F.col(quoted(c)) for c in others)), F.col("__place")).alias("__carried")
    return df.withColumn("__place", place), [carried], others


def _grouped(df: DataFrame, keys: list[str], value: Column, output: str, order_by: str | Sequence[str] | None) -> DataFrame:
    df = df.withColumns({k: F.lit(None).cast("string") for k in keys if not has(df, k)})
    df, carried, others = _carried(df, keys, output, order_by)
    out = df.groupBy(*(F.col(quoted(k)) for k in keys)).agg(value.alias("__value"), *carried)
    return out.select(*(F.col(quoted(k)) for k in keys), *(F.col("__carried")[c].alias(c) for c in others), F.col("__value").alias(output))


@op
def group_count(df: DataFrame, group_by: str | Sequence[str], output: str = "count", order_by: str | Sequence[str] | None = None) -> DataFrame:
    return _grouped(df, _list(group_by), F.count("*"), output, order_by)


def _or_zero(df: DataFrame, name: str) -> Column:
    """The number, zero for null or empty text, null for text that is none."""
    raw = column(df, name)
    return F.when(raw.isNull() | (as_text(df, name) == ""), F.lit(0.0)).otherwise(as_number(df, name))


@op
def group_sum(df: DataFrame, group_by: str | Sequence[str], value: str | None = None, column: str | None = None, output: str | None = None, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """Null counts as zero, text that is no number is left out; a group of only such text sums to zero."""
    name = value or column
    total = F.round(F.sum(F.coalesce(_or_zero(df, name), F.lit(0.0))), 4)
    return _grouped(df, _list(group_by), total, output or f"sum_{name}", order_by)


def _weight(df: DataFrame, name: str) -> Column:
    w = _or_zero(df, name)
    return F.when(w == 0, F.lit(1.0)).otherwise(w)


def _averaged(df: DataFrame, keys: list[str], value: str, weight: str | None, output: str, counted: bool) -> DataFrame:
    df = df.withColumns({k: F.lit(None).cast("string") for k in keys if not has(df, k)})
    v = _or_zero(df, value)
    w = _weight(df, weight) if weight else F.lit(1.0)
    rows = df.select(*(F.col(quoted(k)) for k in keys), v.alias("__v"), w.alias("__w")).where("__v is not null and __w is not null")
    out = rows.groupBy(*(F.col(quoted(k)) for k in keys)).agg(F.count("*").alias("__n"), F.round(F.try_divide(F.sum(F.col("__v") * F.col("__w")), F.sum("__w")), 4).alias("__a"))
    return out.select(*(F.col(quoted(k)) for k in keys), *([F.col("__n").alias(f"{output}_n")] if counted else []), F.col("__a").alias(output))


@op
def group_avg(df: DataFrame, group_by: str | Sequence[str], value: str, output: str | None = None, weight: str | None = None) -> DataFrame:
    """Null counts as zero in the mean; a weight of null or zero counts as one; a group without a number goes."""
    return _averaged(df, _list(group_by), value, weight, output or f"avg_{value}", True)


@op
def weighted_group_avg(df: DataFrame, group_by: str | Sequence[str], value: str, weight: str = "count", output: str | None = None) -> DataFrame:
    return _averaged(df, _list(group_by), value, weight, output or f"wavg_{value}", False)


# -- exponential moving average -----------------------------------------------



def _averages(alpha: float, fill_gaps: bool, most: int = 1 << 16):
    """Averages of series that come in order, batch by batch: only the last average and step are held, however long a series is."""

    def run(batches):
        import pyarrow as pa

        started, group, last, e = False, None, None, 0.0
        for batch in batches:
            keys, steps, values = (batch.column(c).to_pylist() for c in ("g", "s", "v"))
            take, s_out, v_out, e_out, g_out = [], [], [], [], []

            def out(batch=batch, take=take, s_out=s_out, v_out=v_out, e_out=e_out, g_out=g_out):
                rows = {"g": pa.array(g_out, batch.schema.field("g").type), "s": pa.array(s_out, batch.schema.field("s").type), "v": pa.array(v_out, pa.float64()), "p": batch.column("p").take(pa.array(take, pa.int64())), "e": pa.array(e_out, pa.float64())}
                for kept in (take, s_out, v_out, e_out, g_out):
                    kept.clear()
                return pa.RecordBatch.from_pydict(rows)

            for i, (g, s, v) in enumerate(zip(keys, steps, values, strict=True)):
                if not started or g != group:
                    started, group, e = True, g, v
                else:
                    if fill_gaps:
                        for gap in range(last + 1, s):
                            e *= 1 - alpha
                            for kept, x in ((take, None), (s_out, gap), (v_out, 0.0), (e_out, e), (g_out, g)):
                                kept.append(x)
                            if len(take) >= most:
                                yield out()
                    e = alpha * v + (1 - alpha) * e
                last = s
                for kept, x in ((take, i), (s_out, s), (v_out, v), (e_out, e), (g_out, g)):
                    kept.append(x)
            if take:
                yield out()

    return run


@op
def compute_ema(df: DataFrame, group_by: str, sort_by: str, value_col: str = "count", alpha: float = 0.2, output: str = "ema", fill_gaps: bool = True, summarize: bool = True, by_value: bool = False) -> DataFrame:
    """Exponential moving average of each group's series, in whole steps from its first to its last.

    Of rows at one step the last counts; a step without a row counts as zero
    with ``fill_gaps``. ``summarize`` keeps the row of the greatest average, the
    first of equals. ``by_value`` sorts by the average, greatest first.
    """
    g, s = quoted(group_by), quoted(sort_by)
    rows = df.where(F.col(s).isNotNull()).select(F.col(g).alias("g"), F.col(s).alias("s"), F.coalesce(_or_zero(df, value_col), F.lit(0.0)).alias("v"), F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("p"), F.monotonically_increasing_id().alias("i"))
    whole = isinstance(df.schema[sort_by].dataType, T.IntegralType)
    if whole:
        rows = rows.groupBy("g", "s").agg(F.max_by(F.struct("v", "p"), F.col("i")).alias("x")).select("g", "s", "x.v", "x.p")
    points = rows.select("g", "s", "v", "p").repartition("g").sortWithinPartitions("g", "s")
    schema = T.StructType([*points.schema.fields, T.StructField("e", T.DoubleType())])
    out = points.mapInArrow(_averages(alpha, fill_gaps and whole), schema)
    if summarize:
        top = out.groupBy("g").agg(F.max_by(F.struct("s", "v", "e", "p"), F.struct("e", -F.col("s") if whole else F.lit(0))).alias("t"))
        out = top.select("g", "t.s", "t.v", "t.e", "t.p")
    back = out
    named = {group_by: F.col("g"), sort_by: F.col("s")}
    columns = [named[c].alias(c) if c in named else (F.coalesce(F.col("p")[c].cast("double"), F.col("v")).alias(c) if c == value_col and isinstance(df.schema[c].dataType, T.NumericType) else F.col("p")[c].alias(c)) for c in df.columns if c != output]
    result = back.select(*columns, F.round("e", 6).alias(output))
    return result.orderBy(F.desc(output)) if by_value else result
