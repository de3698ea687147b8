"""Each operator over a table and over single rows."""

import math
from datetime import date, datetime

import pytest

from tablepact import col
from tablepact.functions.regex import PatternError, checked, to_java
from tablepact.functions.rows import evaluate
from tablepact.functions.spark import CompileError, Compiler, to_column


def over(spark, values, kind, expr, logical=None):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    kinds = {"x": logical or {"bigint": "int", "double": "float", "string": "str", "boolean": "bool", "timestamp_ntz": "datetime", "date": "date"}[kind]}
    return [r[0] for r in df.select(to_column(expr, kinds, df)).collect()]


def rows(values, expr):
    return [evaluate(expr, {"x": v}) for v in values]


X = col("x")


@pytest.mark.parametrize(
    "expr, kind, values, want",
    [
        (X > 7, "bigint", [9, 7, 3], [True, False, False]),
        (X <= 7, "bigint", [9, 7, 3], [False, True, True]),
        ((X > 2) & (X < 40), "bigint", [2, 39, 40, -1], [False, True, False, False]),
        (X.abs(), "bigint", [-41, 0, 6], [41, 0, 6]),
        (~(X == 3), "bigint", [3, 4], [False, True]),
        (6 + X, "bigint", [-6, 9], [0, 15]),
        (6 - X, "bigint", [-6, 9], [12, -3]),
        (X % 4 == 0, "bigint", [12, 18], [True, False]),
        (X.floor(), "double", [7.25, -7.25], [7, -8]),
        (X.ceil(), "double", [7.25, -7.25], [8, -7]),
        (X.pow(4), "double", [1.5, -2.0], [5.0625, 16.0]),
        (X.is_in(["teal", "plum"]), "string", ["plum", "rust", "teal"], [True, False, True]),
        (X.is_between(-2, 5), "bigint", [-3, -2, 0, 5, 6], [False, True, True, True, False]),
        (X.is_between(-2, 5, closed="left"), "bigint", [-2, 0, 5], [True, True, False]),
        (X.is_between(-2, 5, closed="right"), "bigint", [-2, 0, 5], [False, True, True]),
        (X.is_between(-2, 5, closed="none"), "bigint", [-2, 0, 5], [False, True, False]),
        (X.str.contains(r"^[a-f]{2}\d$"), "string", ["af7", "ag7", "af7\n"], [True, False, False]),
        (X.str.starts_with("S.S."), "string", ["S.S. Ibis", "SS. Ibis"], [True, False]),
        (X.str.ends_with(".log"), "string", ["run.log", "run.logs"], [True, False]),
        (X.str.len_chars(), "string", ["harbour", "🌊é", ""], [7, 2, 0]),
        (X.str.strip_chars(), "string", ["\n mast ", "keel\t"], ["mast", "keel"]),
        (X.str.to_lowercase(), "string", ["QuaY"], ["quay"]),
        (X.str.to_uppercase(), "string", ["quay", "maß"], ["QUAY", "MASS"]),
        (X.str.replace(r"[aeiou]", "*"), "string", ["lighthouse"], ["l*ghth**s*"]),
        (X.str.extract(r"#(\w+)", 1), "string", ["at #dock now", "none"], ["dock", None]),
        (X.str.extract(r"[A-Z]{3}"), "string", ["to OSL", "none"], ["OSL", None]),
        (X.str.slice(0, 4), "string", ["anchor", "oar"], ["anch", "oar"]),
        (X.str.slice(3), "string", ["anchor"], ["hor"]),
        (X.str.slice(-3, 2), "string", ["anchor"], ["ho"]),
        (X.str.count_matches(r"o+"), "string", ["moor book", "reef", "o o o"], [2, 0, 3]),
        (X.str.to_uppercase().str.len_chars() > 3, "string", ["oar", "mast"], [False, True]),
        (X.dt.year(), "timestamp_ntz", [datetime(2011, 8, 30, 17, 45, 9)], [2011]),
        (X.dt.month(), "date", [date(2011, 8, 30)], [8]),
        (X.dt.second(), "timestamp_ntz", [datetime(2011, 8, 30, 17, 45, 9)], [9]),
        (X.dt.total_days(datetime(2011, 8, 1)), "timestamp_ntz", [datetime(2011, 8, 30), datetime(2011, 7, 30)], [29, -2]),
    ],
    ids=str,
)
def test_same_over_tables_and_rows(spark, expr, kind, values, want):
    assert over(spark, values, kind, expr) == want
    assert rows(values, expr) == want


def test_rounding_is_half_even(spark):
    values = [7.34, 7.35, None, 0.85]
    assert over(spark, values, "double", X.round(1)) == [7.3, 7.4, None, 0.8]
    assert rows(values, X.round(1)) == [round(v, 1) if v is not None else None for v in values]


def test_sqrt_of_negatives_is_nan(spark):
    a, b = over(spark, [4.0, -1.0], "double", X.sqrt())
    assert a == 2 and math.isnan(b) and math.isnan(rows([-1.0], X.sqrt())[0])


def test_division_follows_floats(spark):
    got = over(spark, [1.0, -1.0, 0.0, None], "double", X / (X * 0))
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] is None


def test_nulls_in_tables(spark):
    assert over(spark, [None, True, False], "boolean", X.is_null()) == [True, False, False]
    assert over(spark, [1, None], "bigint", X != None) == [None, None]  # noqa: E711
    assert over(spark, ["US", None, "CA"], "string", X.is_in([None, "CA"], nulls_equal=True)) == [False, True, True]
    assert over(spark, ["US", None], "string", X.is_in([None, "CA"])) == [False, None]
    assert over(spark, [5, None], "bigint", (X > 1) | (X < 0)) == [True, None]


def test_nulls_in_rows():
    assert evaluate(X.is_in([None], nulls_equal=True), {"x": None}) is True
    assert evaluate(X.is_in([1]), {"x": None}) is None
    assert evaluate(X.str.contains("a"), {"x": None}) is False and evaluate(X.str.len_chars(), {"x": None}) == 0
    assert evaluate(X.is_null() | (X < 3), {"x": None}) is True
    with pytest.raises(TypeError):
        evaluate(X > 1, {"x": None})
    with pytest.raises(AttributeError):
        evaluate(col("y"), {"x": 1})


def test_overflow_is_null_and_not_an_error(spark):
    assert over(spark, [2**63 - 1], "bigint", X + 1) == [None]
    assert over(spark, [-(2**63)], "bigint", X.abs()) == [-(2**63)]


def test_membership_in_a_column(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (7, 2), (None, None)], "x bigint, y bigint")
    got = {r.x: r[1] for r in df.select("x", to_column(X.is_in(col("y")), {"x": "int", "y": "int"}, df).alias("f")).collect()}
    assert got == {1: True, 2: True, 7: False, None: None}


def test_misuse_is_refused():
    with pytest.raises(TypeError):
        bool(X > 1)
    with pytest.raises(TypeError):
        18 <= X <= 65  # noqa: B015
    with pytest.raises(TypeError):
        X.is_in("abc")
    with pytest.raises(ValueError):
        X.is_between(1, 2, closed="open")
    with pytest.raises(TypeError):
        X.round(1.5)
    with pytest.raises(ValueError):
        X.pow()


def test_inverted_bounds_warn(caplog):
    X.is_between(5, 1)
    assert "above the upper bound" in caplog.text


@pytest.mark.parametrize("expr, kind", [(X > 1, "str"), (X.dt.hour(), "date"), (X.str.len_chars(), "int"), (~X, "int"), (X + 1, "str"), (X & True, "int")], ids=str)
def test_types_are_checked_when_compiled(spark, expr, kind):
    with pytest.raises(CompileError):
        Compiler({"x": kind})(expr)


def test_regex_dialect(spark):
    assert to_java("a$") == r"(?dU)a\z"
    for bad in ("(?=a)", r"(a)\1", "(?<!a)b"):
        with pytest.raises(PatternError):
            to_java(bad)
    with pytest.raises(PatternError):
        checked("(unclosed")
    assert over(spark, ["a\r", "a\n"], "string", X.str.contains("a.")) == [True, False]
    assert over(spark, ["٣"], "string", X.str.contains(r"^\d$")) == [True]
    assert over(spark, ["a[b"], "string", X.str.contains(r"[[b]{2}")) == [True]
    assert over(spark, ["ab"], "string", X.str.replace("(a)(b)", "$2$$1")) == ["b$1"]
