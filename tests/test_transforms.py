"""Truth tables of the transforms."""

import pytest

from lodeweave.operators import stats
from lodeweave.operators.transforms import UnknownOperator, apply


def run(spark, rows, schema, *steps, out=None):
    df = apply(spark.createDataFrame(rows, schema), list(steps))
    return [tuple(r) if out is None else r[out] for r in df.collect()]


def one(spark, values, op, kind="string", **options):
    rows = [(i, v) for i, v in enumerate(values)]
    got = run(spark, rows, f"i int, c {kind}", {"op": op, "column": "c", "output": "o", **options}, {"op": "sort", "by": "i", "direction": "asc"}, out="o")
    return got


def test_extract_number(spark):
    assert one(spark, ["38,715 stars", "stars count of 12", "no", None], "extract_number", metric="stars") == [38715, 12, None, None]


def test_cast_number(spark):
    assert one(spark, ["1,234", " 5 6 ", "1.5", "", None], "cast_number") == [1234, 56, None, None, None]
    assert one(spark, [0, 7], "cast_number", "int") == [None, 7]


def test_sort_and_top_n(spark):
    rows = [(3,), (None,), (1,)]
    assert run(spark, rows, "v int", {"op": "sort", "column": "v"}, out="v") == [None, 3, 1]
    assert run(spark, rows, "v int", {"op": "sort", "column": "v", "direction": "asc"}, out="v") == [1, 3, None]
    assert run(spark, [(5,), (5,), (4,), (4,), (1,), (None,)], "v int", {"op": "top_n_with_ties", "column": "v", "n": 3}, out="v") == [5, 5, 4, 4]
    assert run(spark, [(None,)], "v int", {"op": "top_n_with_ties", "column": "v", "n": 3}, out="v") == []


def test_nested(spark):
    assert one(spark, ['[{"code":"A"},{"code":"B"}]', '{"code":"Z"}', "bad"], "json_array_extract", field="code") == [["A", "B"], ["Z"], None]
    got = run(spark, [(1, [1, 2]), (2, []), (3, None)], "i int, c array<int>", {"op": "json_explode", "column": "c", "output": "o"})
    assert sorted(got, key=str) == [(1, 1), (1, 2), (3, None)]
    got = run(spark, [("a,  b",), ("x, , y",), (None,)], "c string", {"op": "string_explode", "column": "c"}, out="c")
    assert sorted(got) == ["a", "b", "x", "y"]


def test_parse_date(spark):
    assert one(spark, ["May 8, 2012", "2012-05-08", "vol 1999 x", "", None], "parse_date") == ["2012-05-08", "2012-05-08", "1999-01-01", None, None]


def test_groups(spark):
    rows = [("a", 1), ("a", 2), (None, 3)]
    assert sorted(run(spark, rows, "g string, c int", {"op": "group_count", "group_by": "g", "order_by": "c"}), key=str) == [("a", 1, 2), (None, 3, 1)]
    rows = [("a", "1"), ("a", None), ("a", "x"), ("b", "x")]
    assert sorted(run(spark, rows, "g string, v string", {"op": "group_sum", "group_by": "g", "value": "v", "output": "s"}, out="s")) == [0.0, 1.0]
    rows = [("a", "2"), ("a", None), ("a", "x"), ("b", "x")]
    assert run(spark, rows, "g string, v string", {"op": "group_avg", "group_by": "g", "value": "v", "output": "m"}) == [("a", 2, 1.0)]
    rows = [("a", 4, 1), ("a", 2, None), ("a", 1, 0)]
    assert run(spark, rows, "g string, v int, w int", {"op": "group_avg", "group_by": "g", "value": "v", "weight": "w", "output": "m"}) == [("a", 3, 2.3333)]


def test_numbers(spark):
    assert one(spark, [1987, -7, None], "round_down", "int") == [1980, -10, 0]
    assert one(spark, ["x", "19.9"], "round_down") == [None, 10]
    assert run(spark, [("9",), ("10",), ("abc",), (None,)], "v string", {"op": "filter", "column": "v", "min": 10}, out="v") == ["10", "abc"]


def test_text(spark):
    assert one(spark, ["a 1-2", "none"], "regex_extract", pattern=r"(\d+)-(\d+)", group=2) == ["2", None]
    assert one(spark, ["a 1-2"], "regex_extract", pattern=r"(\d+)-(\d+)", group=5) == ["1-2"]
    assert one(spark, ["And x ", None], "string_map", pattern="^and ") == ["x", ""]
    assert one(spark, ["Cafe in Pizza, Italian Food, Wine Bars. In Reno, Nevada", "none"], "text_extract_list") == ["Cafe in Pizza, Italian Food, Wine Bars", None]
    assert one(spark, ["a in b in  c ", "zzz"], "string_after_last", separator="in ") == ["c", None]
    assert one(spark, ["x. y", "x "], "string_before_first", separator=".") == ["x", "x "]
    assert one(spark, ["007-Title", "12. Item"], "string_strip_prefix") == ["Title", "Item"]
    assert one(spark, ["Artist - Song - B"], "string_strip_prefix", preset="before_dash") == ["Song - B"]
    assert one(spark, ["T (x) y (z)"], "string_drop_between") == ["T  y"]
    assert one(spark, ["a-b+c", "x"], "string_after_any_last", separators=["-", "+"]) == ["c", None]
    assert one(spark, ["Project a/b on GitHub", None], "project_name_from_text") == ["a/b", None]
    assert run(spark, [("a",), ("b",)], "c string", {"op": "string_filter", "column": "c", "pattern": "A", "ignore_case": True}, out="c") == ["a"]


def test_ema(spark):
    rows, schema = [("a", 2000, 10), ("a", 2003, 20)], "g string, y int, count int"
    step = {"op": "compute_ema", "group_by": "g", "sort_by": "y"}
    got = run(spark, rows, schema, {**step, "summarize": False})
    assert [r[3] for r in sorted(got)] == [10, 8, 6.4, 9.12]
    assert run(spark, rows, schema, step) == [("a", 2000, 10.0, 10.0)]


def test_chi_square(spark):
    rows = [("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5)]
    got = stats.chi_square(spark.createDataFrame(rows, "r string, c string, count int"), "r", "c").first()
    assert round(got["chi_square"], 7) == 18.7261905 and got["grand_total"] == 65
    got = stats.chi_square(spark.createDataFrame(rows[:3], "r string, c string, count int"), "r", "c").first()
    assert round(got["chi_square"], 6) == 30.0


def test_unknown_and_missing(spark):
    df = spark.range(2)
    with pytest.raises(UnknownOperator):
        apply(df, [{"op": "nope"}])
    assert apply(df, [{"op": "nope"}], strict=False).count() == 2
    assert [r["o"] for r in apply(df, [{"op": "cast_number", "column": "gone", "output": "o"}]).collect()] == [None, None]
