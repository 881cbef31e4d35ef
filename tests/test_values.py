"""Single values, and columns against them."""

import math
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evergrove.functions import columns as C
from evergrove.functions import model
from evergrove.functions.model import Money, Time, Unknown
from evergrove.operators.collections import Collection
from evergrove.plans.compiler import Row, compile_row
from evergrove.plans.parser import parse_expression


def at(text):
    return model.parse_time(text)


@pytest.mark.parametrize(
    ("number", "text"),
    [(0.0, "0"), (1.0, "1"), (1.5, "1.5"), (-2.25, "-2.25"), (100000.0, "100000"), (1e6, "1e+06"), (123456789.0, "1.23456789e+08"), (1e21, "1e+21"), (0.0001, "0.0001"), (0.00012, "0.00012"), (0.00001, "1e-05"), (1234567.0, "1.234567e+06"), (math.inf, "+Inf"), (1e-320, "1e-320")],
)
def test_number_text(number, text):
    assert model.number_text(number) == text


def test_number_text_column_is_the_same(spark):
    numbers = [0.0, 1.0, 1.5, -2.25, 100000.0, 999999.0, 999999.5, 1e6, 1234567.0, 9999999.0, 123456789.0, 1e21, 0.1, 0.001, 0.00099, 0.0001, 0.00012, 0.00001, 1.5e-7, -3e-9, 1e100, math.pi]
    rows = spark.createDataFrame([(float(x),) for x in numbers], "x double").select("x", C.number_text(F.col("x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in rows} == {x: model.number_text(x) for x in numbers}


@pytest.mark.parametrize(
    ("a", "b", "order"),
    [("2026", "2026-06-15", 0), ("2026-01-01 12", "2026-01-01 12:59", 0), ("2026-02-01", "2026-02-02 00:00:01.5", -1), ("2026-02", "2026-01-31", 1), ("2024-01-15", "2024-01-15", 0), ("2026-01-01 00:00:00.5", "2026", 0), ("2025-12-31 23:59:59.9", "2026", -1)],
)
def test_time_order(a, b, order):
    assert model.compare(at(a), at(b)) == order
    assert model.compare(at(b), at(a)) == -order


times = st.builds(lambda d, p: Time(d, p), st.datetimes(datetime(1990, 1, 1), datetime(2040, 1, 1)), st.integers(1, 7))


@given(times)
def test_window_holds_its_instant(t):
    start, end = t.window()
    assert start <= t.at < end
    assert t.precision == 7 or start.microsecond == 0


@given(times, times)
def test_time_order_is_antisymmetric(a, b):
    assert model.compare_times(a, b) == -model.compare_times(b, a)


def test_time_columns_agree_with_the_model(spark):
    stamps = [datetime(2024, 1, 15, 12, 30, 15, 250000), datetime(2024, 1, 15), datetime(2024, 2, 29, 23, 59, 59), datetime(2023, 12, 31, 23, 59, 59, 999999)]
    cases = [(a, p, b, q) for a in stamps for b in stamps for p in range(1, 8) for q in range(1, 8)]
    rows = spark.createDataFrame(cases, "a timestamp_ntz, p int, b timestamp_ntz, q int")
    left, right = C.time_struct(F.col("a"), F.col("p")), C.time_struct(F.col("b"), F.col("q"))
    found = rows.select("*", C.time_order(left, right).alias("o"), C.time_text(left).alias("t"), C.window_start(left).alias("s"), C.window_end(left).alias("e")).collect()
    for r in found:
        x, y = Time(r["a"], r["p"]), Time(r["b"], r["q"])
        assert r["o"] == model.compare_times(x, y)
        assert r["t"] == model.time_text(x)
        assert (r["s"], r["e"]) == x.window()


@pytest.mark.parametrize(("text", "precision"), [("2024", 1), ("2024-05", 2), ("2024-05-06", 3), ("2024-05-06 07", 4), ("2024-05-06 07:08", 5), ("2024-05-06T07:08:09", 6), ("2024-05-06 07:08:09.5", 7)])
def test_parse_time(spark, text, precision):
    assert at(text).precision == precision
    row = spark.range(1).select(C.parse_time(C.literal(text)).value.alias("t")).first()["t"]
    assert (row["ts"], row["prec"]) == (at(text).at, precision)


def test_bad_time_is_unknown(spark):
    assert isinstance(at("yesterday"), Unknown)
    cell = C.parse_time(C.literal("2024-13-01"))
    assert spark.range(1).select(cell.why.alias("r")).first()["r"] == "cannot parse time: 2024-13-01"


@pytest.mark.parametrize(
    ("op", "a", "b", "result"),
    [
        ("+", 1.0, 2.0, 3.0), ("+", "1.5", 2.0, 3.5), ("/", 1.0, 0.0, Unknown("division by zero")), ("%", -7.0, 3.0, -1.0), ("%", 1.0, 0.0, Unknown("modulo by zero")), ("^", 2.0, 10.0, 1024.0),
        ("^", 10.0, 400.0, Unknown("exponentiation result out of range")), ("+", "x", 1.0, Unknown("cannot convert text to number: x")), ("*", Money(2.0, "USD"), 3.0, 6.0), ("-", True, 1.0, Unknown("cannot coerce boolean to number")),
        ("+", Unknown("a"), Unknown("b"), Unknown("a")), ("+", " 1 ", 1.0, Unknown("cannot convert text to number:  1 ")), ("+", "1.5d", 1.0, Unknown("cannot convert text to number: 1.5d")),
    ],
)
def test_arithmetic(spark, op, a, b, result):
    assert model.arithmetic(op, a, b) == result
    cell = C.arithmetic(op, C.literal(a), C.literal(b))
    row = spark.range(1).select(cell.value.alias("v"), cell.why.alias("r")).first()
    assert (row["v"], row["r"]) == ((None, result.reason) if isinstance(result, Unknown) else (result, None))


def evaluated(spark, text, frame=None):
    rows = frame if frame is not None else spark.range(1)
    cell = compile_row(parse_expression(text), Row(Collection(rows)))
    return [(r["v"], r["r"]) for r in rows.select(cell.value.alias("v"), cell.why.alias("r")).collect()]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('upper("aé")', "AÉ"), ('trim(" \t x ")', "x"), ('substring("hello", 1, 3)', "ell"), ('find("añb", "b")', 3.0), ('find("ab", "z")', -1.0), ('replace("aa", "a", "b")', "bb"), ('replace("ab", "", "-")', "-a-b-"),
        ('split("a.b", ".")..count', 2.0), ('len("é")', 2.0), ('length("é")', 1.0), ("round(-2.5)", -3.0), ("floor(2.7)", 2.0), ("max(1, 5, 3)", 5.0), ('"a" & 1 & true', "a1true"), ('"x" & unknown("r")', "xUnknown: r"),
        ("[1, 2, 3][item > 1]..count", 2.0), ("[10, 20, 30]..remove(20)..combine(\",\")", "10,30"), ("[10, 20, 30]..remove(1)..combine(\",\")", "10,30"), ("[1, 2]..append(3)..combine(\"\")", "123"),
        ("not 0", True), ("1 < \"a\"", False), ("1 = 1", True), ("@2024-01 = @2024-01-15", True), ("unknown(\"r\") ?= unknown", True), ("unknown(\"r\") ?= unknown(\"s\")", False), ("1 ?= unknown(\"s\")", False),
        ("$5.00 > $3.00", True), ("$5.00 > €3.00", False), ("text($5.00)", "5.00 USD"), ("text(@2024-01-02 03)", "2024-01-02 03:00"), ("to_json([1, 2])", "[1,2]"), ('split("aaaéaab", "aa")..count', 3.0), ('split("", "x")..count', 1.0), ('split("日x本xx", "x")..count', 4.0), ('split("ab", "")..count', 2.0), ("to_json(2.5)", "2.5"), ("to_json(1000000)", "1000000"), ('to_json("a")', '"a"'), ("to_json(true)", "true"), ("to_json(@2024-01-02)", '"2024-01-02T00:00:00Z"'), ("to_json($2.50)", '{"amount":2.5,"currency":"USD"}'), ('to_json({b: 1, a: [2, 3]})', '{"a":[2,3],"b":1}'), ("(2..4)[0]", 2.0),
    ],
)
def test_expressions_in_columns(spark, text, value):
    assert evaluated(spark, text) == [(value, None)]


@pytest.mark.parametrize(("text", "reason"), [("[1][5]", "list index 5 out of bounds (length 1)"), ("[1][-1]", "list index -1 out of bounds (length 1)"), ('substring("abc", 9, 1)', "invalid substring bounds: start=9, length=1 for string of length 3"), ("nope(1)", "unknown function: nope"), ("1 / 0 > 2", "division by zero"), ("1 / 0 and true", "division by zero")])
def test_unknown_columns(spark, text, reason):
    assert evaluated(spark, text) == [(None, reason)]


def test_nan_compares_with_nothing(spark):
    frame = spark.createDataFrame([(math.nan,), (1.0,), (None,)], "x double")
    collection = Collection(frame)
    for text, kept in [("x > 0", 1), ("x = x", 2), ("x < 5", 1), ("x >= x", 1)]:
        cell = compile_row(parse_expression(text), Row(collection))
        assert collection.filter(cell).frame.count() == kept, text
        assert frame.where(C.truthy(cell)).count() == kept, text


@settings(max_examples=60, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_text_round_trips(x):
    assert float(model.number_text(x)) == x


@given(st.lists(st.floats(-5, 5), max_size=6), st.floats(-2, 8))
def test_removed_drops_at_most_one(items, x):
    from evergrove.plans.interpreter import removed

    left = removed(items, x)
    assert len(items) - len(left) in (0, 1)


def test_json():
    assert model.parse_json('[1,"a",true,null]') == [1.0, "a", True, None]
    assert isinstance(model.parse_json("{"), Unknown)
    assert model.to_json({"b": 1000000.0, "a": Money(1.0, "EUR"), "t": Time(datetime(2024, 1, 2), 3)}) == '{"a":{"amount":1,"currency":"EUR"},"b":1000000,"t":"2024-01-02T00:00:00Z"}'


def test_seconds_of_a_time():
    assert model.to_number(Time(datetime(1970, 1, 2) + timedelta(microseconds=5))) == 86400.0
