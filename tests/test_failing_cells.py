"""Failing cells, unlike types, CSV files as written, and large offsets in running statistics."""

import math

import numpy as np
import pytest
from helpers import rows, sorted_rows

from tablewright import functions as fn
from tablewright import operators as op
from tablewright import sources
from tablewright.plans import jobs
from tablewright.plans.layout import HOT_ROWS_CONF

NAN = float("nan")


@pytest.fixture
def cells(spark):
    return spark.createDataFrame([(1, "7"), (0, "x"), (4, None)], "v long, s string")


def test_failing_expressions_are_values(cells):
    assert sorted_rows(op.filter_rows(cells, "4 / v >= 1"), "v") == [(1,), (4,)]
    made = op.derive(cells, {"q": "4 / v", "i": "cast(s as int)"}, errors=True)
    assert sorted_rows(made, "v", "q", "i") == [(0, None, None), (1, 4.0, 7), (4, 1.0, None)]
    assert sorted_rows(made.filter("i__error is not null"), "v") == [(0,)]  # a null text isn't a failure
    assert sorted_rows(op.conditional(cells, "c", [("4 / v > 2", 1)], 0), "v", "c") == [(0, 0), (1, 1), (4, 0)]
    step = {"conditional": {"column": "c", "conditions": [{"when": "v = 1", "then": 5}], "else": 0}}
    assert sorted_rows(jobs.apply_step(cells, step), "v", "c") == [(0, 0), (1, 5), (4, 0)]


def test_unlike_values_never_match(cells):
    assert op.filter_value(cells, "v", "==", "abc").count() == 0 and op.filter_value(cells, "v", "!=", "abc").count() == 3
    assert sorted_rows(op.filter_value(cells, "s", ">", 3), "s") == [("7",)]
    assert sorted_rows(op.filter_range(cells, "s", 1, 9), "s") == [("7",)]
    assert sorted_rows(op.replace_value(cells, "v", 0, "none"), "v") == [("1",), ("4",), ("none",)]
    assert op.replace_value(cells, "v", "abc", 9).filter("v = 9").count() == 0
    other = cells.selectExpr("s as key", "v as w")
    assert op.join(cells, other, [("v", "key")]).count() == 0
    assert op.semijoin(cells.selectExpr("v + 6 as v"), other, [("v", "key")]).count() == 1
    assert op.antijoin(cells, other, [("v", "key")]).count() == 3


def test_invalid_patterns_leave_values(cells):
    assert {r[0] for r in op.replace_regex(cells, "s", "(", "-").select("s").collect()} == {"7", "x", None}
    kept = rows(cells.select(fn.regexp_match("s", "(").alias("m"), fn.regexp_extract("s", "x", 3).alias("e"), fn.regexp_replace("s", "[", "-").alias("r")))
    assert kept == [(False, None, "7"), (False, None, "x"), (None, None, None)]


def test_rows_tied_on_nan_stay(spark):
    df = spark.createDataFrame([(NAN,)] * 3, "x double")
    assert op.slice_rows(df, 1, "removeFirst", ["x"]).count() == 2
    df = spark.createDataFrame([(1, NAN), (1, NAN), (2, 3.0)], "k long, x double")
    assert op.slice_rows(df, 1, "removeFirst", ["k", "x"]).count() == 2


def test_csv_keeps_what_the_text_has(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('n,d,e,z\n12345678901234567890,25/12/2024,2024-02-30,"a\nb"\n1,01/02/2024,2024-02-28,"say ""hi"", ok"\n')
    df = sources.read_csv(spark, str(path))
    text = sources.read_csv(spark, str(path), infer=False)
    assert df.count() == 2 and sorted_rows(text, "z") == [("a\nb",), ('say "hi", ok',)]
    nulls = lambda d: sum(v is None for r in d.collect() for v in r)
    assert nulls(df) == nulls(text) == 0
    quoted = tmp_path / "b.csv"
    quoted.write_text('"a ""q"", b",c\n1,2\n')
    assert sources.read_csv(spark, str(quoted)).columns == ['a "q", b', "c"]


def test_ragged_rows_fail_unless_kept(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_csv(spark, str(path), infer=False).collect()
    assert rows(sources.read_csv(spark, str(path), strict=False, infer=False)) == [("1", "2")]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_a_job_reads_what_a_job_wrote(spark, tables, tmp_path, fmt):
    docs = f"{tmp_path}/docs.parquet"
    tables.documents.write.parquet(docs)
    job = {"sources": {"docs": {}}, "models": {"m": {"source": "docs", "steps": [{"select": ["doc_id", "text"]}]}}, "outputs": ["m"]}
    written = jobs.run_job(spark, job, {"docs": docs}, f"{tmp_path}/out", fmt)["m"]
    again = jobs.bind_sources(spark, job, {"docs": written})["docs"]
    assert sorted_rows(again, "doc_id", "text") == sorted_rows(tables.documents, "doc_id", "text")


def test_running_variance_with_a_large_offset(spark):
    df = spark.createDataFrame([(i, 1e9 + i / 1000) for i in range(1200)], "i long, x double")
    want = rows(op.window(df, {"s": ("stdev", "x")}, ["i"]).orderBy("i"), "s")
    spark.conf.set(HOT_ROWS_CONF, "100")
    try:
        got = rows(op.window(df, {"s": ("stdev", "x")}, ["i"]).orderBy("i"), "s")
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert all(a == b or math.isclose(a[0], b[0], rel_tol=1e-4) for a, b in zip(got[2:], want[2:]))


@pytest.mark.parametrize("limit", ["2000000", "100"])
def test_running_spread_keeps_ten_digits_far_from_zero(spark, limit):
    near = np.array([(1e9 + i / 1000) - 1e9 for i in range(1200)])
    df = spark.createDataFrame([(i, 1e9 + i / 1000) for i in range(1200)], "i long, x double")
    frames = {"whole": (None, None), "near": (-9, 5), "rest": (0, None)}
    spark.conf.set(HOT_ROWS_CONF, limit)
    try:
        found = op.window(df, {n: ("variance", "x") for n in ("run", *frames)}, ["i"], frames=frames).orderBy("i").collect()
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    for i in (9, 600, 1150):
        want = {"run": near[: i + 1], "whole": near, "near": near[i - 9 : i + 6], "rest": near[i:]}
        for name, values in want.items():
            assert math.isclose(found[i][name], np.var(values, ddof=1), rel_tol=1e-10)


def test_running_spread_with_missing_and_infinite_values(spark):
    values = [None, 1.0, 3.0, None, float("nan"), 2.0]
    df = spark.createDataFrame(list(enumerate(values)), "i long, x double")
    found = [r["s"] for r in op.window(df, {"s": ("variance", "x")}, ["i"]).orderBy("i").collect()]
    assert found[:4] == [None, None, 2.0, 2.0] and all(math.isnan(x) for x in found[4:])
    alone = spark.createDataFrame([(0, float("inf")), (1, 1.0)], "i long, x double")
    assert [r["s"] for r in op.window(alone, {"s": ("count", "x"), "v": ("stdev", "x")}, ["i"]).orderBy("i").collect()] == [1, 2]


@pytest.fixture
def stored(cells, tmp_path):
    """The cells as a file: from a local relation Spark computes results while planning."""
    cells.write.parquet(str(tmp_path / "cells"))
    return cells.sparkSession.read.parquet(str(tmp_path / "cells"))


def test_failing_parts_that_expressions_share(stored):
    made = op.derive(stored, {"n": "cast(s as int)"}, errors=True)
    assert sorted_rows(made.filter("n__error is not null"), "v") == [(0,)] and sorted_rows(made, "v", "n") == [(0, None), (1, 7), (4, None)]
    made = op.derive(stored, {"n": "cast(s as int) + 1", "m": "cast(s as int) + 2"})
    assert sorted_rows(made, "v", "n", "m") == [(0, None, None), (1, 8, 9), (4, None, None)]
    assert sorted_rows(op.derive(stored, {"n": "4 / v + 1", "m": "4 / v + 2"}), "v", "n", "m") == [(0, None, None), (1, 5.0, 6.0), (4, 2.0, 3.0)]
    made = op.derive(stored, {"n": "cast(s as int)", "m": "n + 1"}, errors=True)
    assert sorted_rows(made, "v", "n", "m") == [(0, None, None), (1, 7, 8), (4, None, None)]
    made = op.conditional(stored, "k", [("cast(s as int) > 9", "a"), ("cast(s as int) > 5", "b")], "c")
    assert sorted_rows(made, "v", "k") == [(0, "c"), (1, "b"), (4, "c")]
    assert sorted_rows(op.filter_rows(stored, "cast(s as int) between 1 and 9"), "v") == [(1,)]
    assert sorted_rows(op.filter_rows(op.filter_rows(stored, "4 / v >= 1"), "4 / v < 3 and 4 / v > 0.5"), "v") == [(4,)]
    assert sorted_rows(op.derive(stored, {"n": "1 / 0", "w": "sum(v) over (partition by s is null)"}, errors=True), "v", "n", "w") == [(0, None, 1), (1, None, 1), (4, None, 4)]


def test_failed_cells_in_a_job(stored):
    steps = [{"derive": {"q": "4 / v", "i": "cast(s as int)", "safe": "upper(s)"}}, {"replace": {"column": "q", "matchMode": "errors", "replace": -1.0}}]
    made = jobs.run_steps(stored, steps)
    assert made.columns == ["v", "s", "q", "q__error", "i", "i__error", "safe"]
    assert sorted_rows(made, "v", "q", "i", "safe") == [(0, -1.0, None, "X"), (1, 4.0, 7, "7"), (4, 1.0, None, None)]
    again = jobs.run_steps(made, [{"derive": {"i": "v"}}])  # a column that can't fail has no old failures
    assert "i__error" not in again.columns
    filled = jobs.run_steps(stored, [{"derive": {"i": "cast(s as int)"}}, {"impute": {"column": "i", "strategy": "constant", "value": 5}}])
    assert sorted_rows(filled, "v", "i") == [(0, 5), (1, 7), (4, 5)]


def pushed(df):
    import re

    df.sparkSession.conf.set("spark.sql.maxMetadataValueLength", "2000")
    return re.findall(r"PushedFilters: \[([^\n]*)", df._jdf.queryExecution().executedPlan().toString())[0]


def test_conditions_that_cannot_fail_reach_the_scan(tables):
    o = tables.orders
    assert "EqualTo(o_custkey,5)" in pushed(op.filter_rows(o, "o_orderkey > 100 and o_custkey = 5"))
    mixed = pushed(op.filter_rows(o, "o_totalprice / (o_custkey % 7) > 50000 and o_custkey = 5 and (o_orderstatus = 'F' or o_orderkey in (1, 2))"))
    assert "EqualTo(o_custkey,5)" in mixed and "EqualTo(o_orderstatus,F)" in mixed and "o_totalprice,5" not in mixed
    assert "GreaterThanOrEqual(o_orderdate" in pushed(op.filter_rows(o, "o_orderdate >= '1995-01-01'"))
    assert "EqualTo(o_custkey,5)" in pushed(op.filter_value(o, "o_custkey", "==", 5))
    assert "Not(EqualNullSafe(o_custkey,5))" in pushed(op.filter_value(o, "o_custkey", "!=", 5))
    assert "EqualTo(o_orderdate" in pushed(op.filter_value(o, "o_orderdate", "==", "1995-01-01"))
    assert "GreaterThan(o_custkey,5)" in pushed(jobs.run_steps(o, [{"filter": "o_custkey > 5"}, {"derive": {"x": "o_totalprice / o_custkey"}}]))
    # Without a failing part there is nothing to try, and the plan is Spark's own.
    assert "tryeval" not in op.derive(o, {"x": "o_totalprice * 2", "y": "coalesce(o_orderstatus, 'n')"})._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_are_pruned(spark, stored, tmp_path):
    stored.withColumn("day", stored.v % 2).write.partitionBy("day").parquet(str(tmp_path / "days"))
    made = op.filter_rows(spark.read.parquet(str(tmp_path / "days")), "day = 1 and 4 / v > 0")
    assert "PartitionFilters: [isnotnull(day" in made._jdf.queryExecution().executedPlan().toString() and sorted_rows(made, "v") == [(1,)]


def test_inference_keeps_every_value(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("a,b,c,d,e,f\n1.5,9007199254740993,2024-01-02T10:00:00+02:00,1e3,1.5,2024-01-02T10:00:00Z\n9007199254740993,1,2024-06-02T23:30:00-0130,9007199254740993,2,2024/1/2\n,,2024-01-02 10:00:00,1,-3.25,2024-01-02\n")
    df = sources.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "decimal(17,1)", "b": "bigint", "c": "timestamp_ntz", "d": "string", "e": "double", "f": "string"}
    r = df.collect()
    assert [str(x["a"]) for x in r] == ["1.5", "9007199254740993.0", "None"] and [x["b"] for x in r] == [9007199254740993, 1, None]
    assert [str(x["c"]) for x in r] == ["2024-01-02 08:00:00", "2024-06-03 01:00:00", "2024-01-02 10:00:00"]


def test_offsets_do_not_depend_on_the_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        d = spark.createDataFrame([("2024-03-10T02:30:00+02:00",), ("2024-11-03T06:30:00.25Z",), ("2024-11-03 01:30:00",)], "s string")
        got = [str(r[0]) for r in op.types(d, {"s": "datetime"}).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-03-10 00:30:00", "2024-11-03 06:30:00.250000", "2024-11-03 01:30:00"]
