"""Values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright import functions as fn

def t(text):
    return F.lit(text)


def cases():
    no_text = F.lit(None).cast("string")
    no_number = F.lit(None).cast("double")
    return [
        # text
        (fn.upper(t("aß")), "ASS"), (fn.lower(t("ÄB")), "äb"), (fn.titlecase(t("hELLO big-world")), "Hello Big-world"),
        (fn.trim(t("\t a b \n")), "a b"), (fn.substring(t("hello"), 1, 3), "ell"), (fn.substring(t("hello"), -3, 2), "he"), (fn.substring(t("hello"), 3), "lo"),
        (fn.length(t("héllo")), 5), (fn.length(no_text), None), (fn.split(t("a.b.c"), "."), "a"), (fn.split(t("a.b.c"), ".", 2), "c"),
        (fn.split(t("a.b.c"), ".", -1), "c"), (fn.split(t("a.b.c"), ".", 3), None), (fn.split(t("a.b"), ".", -3), None), (fn.split(t(r"a\Eb"), r"\E", 1), "b"),
        (fn.equals(t("a"), "a"), True), (fn.equals(no_text, "a"), False), (fn.contains(t("abc"), "b"), True), (fn.contains(no_text, "b"), False),
        (fn.starts_with(t("abc"), "ab"), True), (fn.ends_with(t("abc"), "bc"), True), (fn.equals_ci(t("Ab"), "aB"), True), (fn.contains_ci(t("xABy"), "ab"), True),
        (fn.starts_with_ci(t("ABc"), "ab"), True), (fn.ends_with_ci(t("abC"), "BC"), True), (fn.upper(F.lit(12)), "12"), (fn.concat(t("a"), F.lit(1)), "a1"),
        (fn.concat(t("a"), no_text), None),
        # regex
        (fn.regexp_match(t("Order 66"), r"(?i)order \d+"), True), (fn.regexp_match(no_text, "x"), None), (fn.regexp_extract(t("a1b22"), r"\d+"), "1"),
        (fn.regexp_extract(t("k=v"), "(.)=(.)", 2), "v"), (fn.regexp_extract(t("none"), r"\d"), None), (fn.regexp_replace(t("a1b2"), r"(\d)", "<$1>"), "a<1>b<2>"),
        (fn.regexp_replace(t("a1b2"), r"\d", None), "ab"),
        # dates
        (fn.year(t("2024-03-15")), 2024), (fn.month(t("03/15/2024")), 3), (fn.day(t("Jan 5, 2024")), 5), (fn.hour(t("2024-03-15T10:20:30")), 10),
        (fn.minute(t("2024-03-15 10:20:30")), 20), (fn.second(t("2024-03-15T10:20:30.5Z")), 30), (fn.year(t("soon")), None), (fn.year(no_text), None),
        (fn.weekday(t("2024-01-01")), 0), (fn.weekday(t("2024-01-07")), 6), (fn.week(t("2024-12-30")), 1), (fn.week(t("2021-01-03")), 53), (fn.quarter(t("2024-11-01")), 4),
        (fn.days_between(t("2024-01-01"), t("2024-01-15")), 14), (fn.days_between(t("2024-01-02T23:00:00"), t("2024-01-01T01:00:00")), -1),
        (fn.date_add(t("2024-01-31"), 1, "months"), dt.date(2024, 3, 2)), (fn.date_add(t("2023-01-31"), 1, "month"), dt.date(2023, 3, 3)),
        (fn.date_add(t("2024-02-29"), 1, "years"), dt.date(2025, 3, 1)), (fn.date_add(t("2024-03-31"), -1, "month"), dt.date(2024, 3, 2)),
        (fn.date_add(t("2024-01-15"), 30, "days"), dt.date(2024, 2, 14)), (fn.date_add(t("2024-01-15"), 25, "hours"), dt.datetime(2024, 1, 16, 1)),
        (fn.date_add(t("2024-01-15T10:00:00"), -90, "minutes"), dt.datetime(2024, 1, 15, 8, 30)), (fn.date_add(t("2024-01-15"), 61, "seconds"), dt.datetime(2024, 1, 15, 0, 1, 1)),
        (fn.date_trunc(t("2024-05-15"), "quarter"), dt.date(2024, 4, 1)), (fn.date_trunc(t("2024-01-07"), "week"), dt.date(2024, 1, 1)),
        (fn.date_trunc(t("2024-01-15T14:37:10"), "minute", 5), dt.datetime(2024, 1, 15, 14, 35)), (fn.date_trunc(t("2024-01-15T14:37:00"), "hour", 4), dt.datetime(2024, 1, 15, 12)),
        (fn.date_trunc(t("2024-01-15T14:37:48"), "second", 20), dt.datetime(2024, 1, 15, 14, 37, 40)),
        (fn.format_date(t("2024-01-05T09:07:03"), "DD/MM/YYYY HH:mm:ss"), "05/01/2024 09:07:03"), (fn.format_date(t("2024-01-05T09:07:03"), "D.M.YY H-m-s"), "5.1.24 9-7-3"),
        (fn.parse_date(t("15/06/2024"), "DD/MM/YYYY"), dt.date(2024, 6, 15)), (fn.parse_date(t("31/02/2024"), "DD/MM/YYYY"), None),
        (fn.parse_date(t("1/6/70"), "D/M/YY"), dt.date(1970, 6, 1)), (fn.parse_date(t("1/6/69"), "D/M/YY"), dt.date(2069, 6, 1)),
        (fn.parse_date(t("2024-06-15 14:30"), "YYYY-MM-DD HH:mm"), dt.datetime(2024, 6, 15, 14, 30)), (fn.parse_date(t("5/6/2024"), "DD/MM/YYYY"), None),
        (fn.parse_date(t("2024-06"), "YYYY-MM"), None), (fn.parse_date(t(" 20240615 "), "YYYYMMDD"), dt.date(2024, 6, 15)), (fn.parse_date(t("15/06/2024x"), "DD/MM/YYYY"), None),
        # math
        (fn.round_(F.lit(2.5)), 3.0), (fn.round_(F.lit(-2.5)), -2.0), (fn.round_(F.lit(1.2345), 2), 1.23), (fn.round_(F.lit(1250), -2), 1300.0), (fn.abs_(t("-3.5")), 3.5),
        (fn.sqrt(F.lit(-1)), None), (fn.ln(F.lit(0)), None), (fn.log10(F.lit(1000)), 3.0), (fn.log2(F.lit(8)), 3.0), (fn.asin(F.lit(2)), None), (fn.acos(F.lit(1)), 0.0),
        (fn.trunc(F.lit(-2.7)), -2.0), (fn.trunc(F.lit(2.7)), 2.0), (fn.floor(F.lit(-2.1)), -3.0), (fn.ceil(F.lit(2.1)), 3.0), (fn.floor(F.lit(1e300)), 1e300),
        (fn.min_(F.lit(3), no_number, t("1")), 1.0), (fn.max_(F.lit(3), no_number, t("1")), 3.0), (fn.pow_(F.lit(2), 10), 1024.0), (fn.pow_(F.lit(-8), 1 / 3), None),
        (fn.cbrt(F.lit(27)), 3.0), (fn.sign(F.lit(-4)), -1.0), (fn.abs_(t("abc")), None), (fn.abs_(t("1d")), None), (fn.degrees(fn.pi()), 180.0),
        (fn.divide(F.lit(1), 0), None), (fn.mod(F.lit(-7), 3), -1.0), (fn.mod(F.lit(7), 0), None),
        # types
        (fn.parse_int(t("12abc")), 12), (fn.parse_int(t(" -7.9")), -7), (fn.parse_int(t("abc")), None), (fn.parse_float(t("3.5kg")), 3.5), (fn.parse_float(t("-1e3x")), -1000.0),
        (fn.is_nan(t("abc")), True), (fn.is_nan(t("12")), False), (fn.is_nan(no_text), False), (fn.if_(F.lit(None).cast("boolean"), 1, 2), 2), (fn.if_(F.lit(True), 1, 2), 1),
        (fn.coalesce(no_number, F.lit(2.0)), 2.0), (fn.not_(F.lit(None).cast("boolean")), True), (fn.eq(no_number, F.lit(None)), True), (fn.ne(no_number, F.lit(5.0)), True),
        # json
        (fn.is_json(t("[1]")), True), (fn.is_json(t("{x")), False), (fn.is_json(no_text), None), (fn.json_extract(t('{"a":[{"b":7}]}'), "a.0.b"), "7"),
        (fn.json_extract(t('{"a":[{"b":7}]}'), "a.0.b", "int"), 7), (fn.json_extract(t('{"a":1}'), "x"), None), (fn.json_keys(t('{"a":1,"b":2}')), ["a", "b"]),
        (fn.json_array_length(t("[1,2,3]")), 3), (fn.json_array_length(t("{}")), None), (fn.json_type(t("[1]")), "array"), (fn.json_type(t('{"a":1}')), "object"),
        (fn.json_type(t("1.5")), "number"), (fn.json_type(t('"x"')), "string"), (fn.json_type(t("true")), "boolean"), (fn.json_type(t("null")), "null"), (fn.json_type(t("{x")), None),
        (fn.json_stringify(t('a"b')), '"a\\"b"'), (fn.json_stringify(F.lit(5)), "5"), (fn.json_stringify(F.array(F.lit(1), F.lit(2)), nested=True), "[1,2]"),
    ]


def test_values(spark):
    known = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(known)]).first()
    wrong = [(i, str(known[i][0])[:80], v, known[i][1]) for i, v in enumerate(row) if not same(v, known[i][1])]
    assert wrong == []


def same(got, want):
    if isinstance(want, float) and got is not None:
        return got == pytest.approx(want, abs=1e-9)
    return got == want and type(got) is type(want)


def test_dates_of_typed_columns(spark):
    d = spark.sql("select date'2024-03-15' d, timestamp_ntz'2024-03-15 10:20:30' t")
    assert d.select(fn.hour("d"), fn.hour("t"), fn.date_trunc("t", "day"), fn.format_date("d", "YYYY/M/D")).first() == (0, 10, dt.date(2024, 3, 15), "2024/3/15")
    assert spark.range(1).select(fn.days_between(fn.today(), fn.now())).first()[0] == 0


def test_unknown_units(spark):
    with pytest.raises(ValueError, match="unknown unit"):
        fn.date_add(t("2024-01-01"), 1, "fortnight")
    with pytest.raises(ValueError, match="unknown unit"):
        fn.date_trunc(t("2024-01-01"), "fortnight")


def test_registry_is_complete():
    assert len(fn.FUNCTIONS) == 72 and all(callable(f) for f in fn.FUNCTIONS.values())


def test_functions_stay_in_the_jvm(spark):
    plan = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases())])._jdf.queryExecution().toString()
    assert "Python" not in plan
