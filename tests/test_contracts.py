"""Null, error, naming and degenerate-input rules on small tables."""

import pytest
from helpers import rows, sorted_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import functions as fn
from tablewright import operators as op


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "id int, name string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(1, 10), (None, 20), (4, 40)], "id int, score int")


@pytest.mark.parametrize("how, n", [("inner", 1), ("left", 3), ("right", 3), ("full", 5), ("cross", 9)])
def test_null_keys_never_match(left, right, how, n):
    out = op.join(left, right, "id", how)
    assert out.count() == n
    assert out.columns == (["id_x", "name", "id_y", "score"] if how == "cross" else ["id", "name", "score"])


def test_null_keys_in_filtering_joins(left, right):
    assert sorted_rows(op.semijoin(left, right, "id")) == [(1, "a")]
    assert sorted_rows(op.antijoin(left, right, "id")) == [(None, "b"), (3, "c")]
    looked = op.lookup(left, right, "id", ["score"], order_by="score")
    assert sorted_rows(looked) == [(None, "b", None), (1, "a", 10), (3, "c", None)]


def test_full_join_merges_same_named_keys(left, right):
    got = sorted_rows(op.join(left, right, "id", "full"))
    assert got == [(None, None, 20), (None, "b", None), (1, "a", 10), (3, "c", None), (4, None, 40)]


def test_lookup_takes_the_last_match(spark, left):
    twice = spark.createDataFrame([(1, 100), (1, 999)], "id int, score int")
    assert (1, "a", 999) in rows(op.lookup(left, twice, "id", ["score"], order_by="score"))
    with pytest.raises(ValueError, match="order_by"):
        op.lookup(left, twice, "id", ["score"])


def test_right_table_without_columns(spark, left):
    nothing = spark.createDataFrame([], T.StructType([]))
    for how, n in (("inner", 0), ("right", 0), ("cross", 0), ("left", 3), ("full", 3)):
        out = op.join(left, nothing, "id", how)
        assert (out.count(), out.columns) == (n, ["id", "name"])
    assert op.semijoin(left, nothing, "id").count() == 0
    assert op.antijoin(left, nothing, "id").count() == 3
    assert rows(op.lookup(left, nothing, "id", ["score"]))[0][2] is None


def test_join_suffixes_and_clashes(spark):
    a = spark.createDataFrame([(1, 2, 3)], "id int, v int, w_y int")
    b = spark.createDataFrame([(1, 5, 6)], "id int, v int, w int")
    assert op.join(a, b, "id").columns == ["id", "v_x", "w_y", "v_y", "w"]
    c = spark.createDataFrame([(1, 5, 6)], "id int, v int, v_x int")
    with pytest.raises(ValueError, match="overwrite"):
        op.join(a, c, "id")


def test_join_two_differently_named_keys(spark):
    a = spark.createDataFrame([(1, "x", 7)], "a int, b string, v int")
    b = spark.createDataFrame([(1, "x", 8)], "k int, l string, v int")
    assert rows(op.join(a, b, [("a", "k"), ("b", "l")])) == [(1, "x", 7, 1, "x", 8)]


def test_aggregates_of_nulls(spark):
    d = spark.createDataFrame([("n", None), ("n", None), (None, 4)], "g string, v int")
    out = op.aggregate(
        d, {"valid": ("valid", "v"), "distinct": ("distinct", "v"), "sum": ("sum", "v"), "mode": ("mode", "v"), "med": ("median", "v")}, ["g"]
    )
    assert sorted_rows(out) == [(None, 1, 1, 4.0, 4, 4.0), ("n", 0, 1, None, None, None)]


def test_aggregate_rounding_and_names(spark):
    d = spark.createDataFrame([(0.1,), (0.2,)], "v double")
    assert op.aggregate(d, {"s": ("sum", "v")}).first()[0] == 0.3
    with pytest.raises(ValueError, match="overwrite"):
        op.aggregate(d, {"v": "count"}, ["v"])
    with pytest.raises(ValueError, match="unknown aggregate"):
        op.aggregate(d, {"s": ("corr", "v")})
    with pytest.raises(ValueError, match="order_by"):
        op.aggregate(d, {"s": ("first", "v")})


def test_nan_is_missing_for_valid(spark):
    d = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    out = op.aggregate(d, {"valid": ("valid", "v"), "invalid": ("invalid", "v"), "sum": ("sum", "v")})
    assert rows(out) == [(1, 2, 1.0)]


def test_aggregate_without_rows(spark):
    d = spark.createDataFrame([], "g string, v int")
    assert rows(op.aggregate(d, {"n": "count", "s": ("sum", "v"), "d": ("distinct", "v")})) == [(0, None, 0)]
    assert op.aggregate(d, {"n": "count"}, ["g"]).count() == 0


def test_approximate_aggregates(tables):
    out = op.aggregate(tables.orders, {"d": ("distinct", "o_custkey"), "m": ("median", "o_totalprice")}, approx=True)
    exact = op.aggregate(tables.orders, {"d": ("distinct", "o_custkey"), "m": ("median", "o_totalprice")})
    (d, m), (de, me) = rows(out)[0], rows(exact)[0]
    assert abs(d - de) < 0.2 * de and abs(m - me) < 0.1 * me


def test_comparison_rules(spark):
    d = spark.createDataFrame([(None,), (5,), (6,)], "x int")
    assert rows(op.filter_rows(d, fn.ne("x", 5))) == [(None,), (6,)]
    assert rows(op.filter_rows(d, fn.eq("x", F.lit(None)))) == [(None,)]
    assert rows(op.filter_rows(d, fn.not_(F.col("x") > 5))) == [(None,), (5,)]
    assert rows(op.filter_value(d, "x", "==", None)) == [(None,)]
    assert rows(op.filter_value(d, "x", "!=", None)) == [(5,), (6,)]
    assert op.filter_rows(d, "x > 100").columns == ["x"]


def test_error_columns(spark):
    d = spark.createDataFrame([("1",), ("x",), (None,), (" ",), ("1e3",), ("-2.9",)], "v string")
    out = op.types(d, {"v": "integer", "absent": "date"}, errors=True)
    assert [r[0] for r in rows(out)] == [1, None, None, None, 1000, -2]
    assert [r[1] for r in rows(out)] == [None, 'cannot convert "x" to integer', None, None, None, None]
    assert rows(op.replace_errors(out, "v", 0), "v")[1] == (0,)
    assert [r[0] for r in rows(op.replace_nulls(out, "v", 7), "v")] == [1, None, 7, 7, 1000, -2]
    assert [r[0] for r in rows(op.impute(out, "v", "constant", 9), "v")] == [1, 9, 9, 9, 1000, -2]
    assert op.impute(out, "v", "constant", 9).filter("v__error is not null").count() == 0
    assert op.filter_rows(out, fn.is_error("v")).count() == 1
    assert rows(op.quality(out)) == [("v", 33.333333, 16.666667)]


@pytest.mark.parametrize(
    "target, text, want",
    [
        ("float", "Infinity", None), ("float", "NaN", None), ("float", "1e500", None), ("float", "1.5e-3", 0.0015), ("float", "1d", None),
        ("integer", "9007199254740993", 9007199254740993), ("integer", "12abc", None), ("boolean", "YES", True), ("boolean", "off", False),
        ("boolean", "2.5", True), ("boolean", "maybe", None), ("date", "2024-02-30", None), ("date", "3/5/2024", "2024-03-05"),
        ("date", "2024/03/05", "2024-03-05"), ("date", "Jan 1 2000", "2000-01-01"), ("datetime", "2024-01-01T10:00:00Z", "2024-01-01 10:00:00"),
        ("datetime", "2024-01-01", "2024-01-01 00:00:00"), ("json", '{"a": [1]}', '{"a": [1]}'), ("json", "{a", None), ("json", "", None),
    ],
)
def test_conversion_from_text(spark, target, text, want):
    d = spark.createDataFrame([(text,)], "v string")
    value, error = op.types(d, {"v": target}, errors=True).first()
    assert (str(value) if target in ("date", "datetime") and value else value) == want
    assert (error is None) == (want is not None)


def test_conversion_between_values(spark):
    d = spark.sql("select 2.7D as f, true as b, date'2024-03-01' as d, timestamp_ntz'2024-03-01 10:00:00' as t, array(1,2) as a, -2.7D as g")
    out = op.types(d, {"f": "integer", "g": "integer", "b": "float", "d": "string", "t": "date", "a": "json"})
    assert [str(v) for v in out.first()] == ["2", "1.0", "2024-03-01", "2024-03-01", "[1,2]", "-2"]
    assert op.types(d, {"t": "string"}).first()["t"] == "2024-03-01T10:00:00"


def test_inference(spark):
    d = spark.createDataFrame(
        [("1", "1.5", "007", "true", "2024-01-01", "2024-01-01 10:00:00", "[1]", "a", None, "1e500")] * 3
        + [("2", "3", "12", "FALSE", "3/4/2024", "2024-01-01T10:00:00Z", '{"a":1}', "1", None, "2")],
        "i string, f string, z string, b string, d string, dt string, j string, s string, n string, x string",
    )
    want = dict(i="integer", f="float", z="string", b="boolean", d="date", dt="datetime", j="json", s="string", n="string", x="string")
    assert op.infer_types(d) == want
    assert op.infer_types(d, keep_leading_zeros=False)["z"] == "integer"


def test_promotion():
    assert [op.promote(a, b) for a, b in (("integer", "float"), ("date", "datetime"), ("json", "integer"), ("boolean", "date"))] == [
        "float", "datetime", "string", "string",
    ]


def test_generated_names_never_overwrite(spark):
    d = spark.createDataFrame([("a-b", 1, [1])], "s string, s_2 int, arr array<int>")
    with pytest.raises(ValueError, match="s_2"):
        op.split(d, "s", "-")
    with pytest.raises(ValueError, match="overwrite"):
        op.unroll(d.withColumn("arr__unroll_index", F.lit(1)), "arr", indices=True)
    with pytest.raises(ValueError, match="overwrite"):
        op.spread(d.withColumn("arr_1", F.lit(1)), "arr")
    with pytest.raises(ValueError, match="overwrite"):
        op.pivot(spark.createDataFrame([("k", "k", 1)], "k string, key string, v int"), ["k"], "key", "v")


def test_split_modes(spark):
    d = spark.createDataFrame([(1, "a-b-c"), (2, "x"), (3, None)], "id int, s string")
    assert rows(op.split(d, "s", "-")) == [(1, "a", "b", "c"), (2, "x", None, None), (3, None, None, None)]
    assert rows(op.split(d, "s", "-", "lastN", 2)) == [(1, "b", "c"), (2, None, "x"), (3, None, None)]
    assert rows(op.split(d, "s", "-", "right")) == [(1, "c"), (2, "x"), (3, None)]
    assert rows(op.split(d, "s", "-", "left", keep_original=True)) == [(1, "a-b-c", "a"), (2, "x", "x"), (3, None, None)]
    assert op.split(d, "s", ".", "spread").columns == ["id", "s_1"]
    assert op.split(d, "s", "[-]", "spread", regex=True).columns == ["id", "s_1", "s_2", "s_3"]


def test_unroll_and_spread(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, items array<string>")
    assert rows(op.unroll(d, "items", indices=True)) == [(1, "a", 0), (1, "b", 1)]
    assert rows(op.unroll(d, "items", keep_original=True)) == [(1, ("a", "b"), "a"), (1, ("a", "b"), "b")]
    text = spark.createDataFrame([(1, '["a","b"]'), (2, "[]"), (3, "plain")], "id int, items string")
    assert rows(op.unroll(text, "items")) == [(1, "a"), (1, "b"), (3, "plain")]
    assert rows(op.spread(d, "items")) == [(1, "a", "b"), (2, None, None), (3, None, None)]
    assert op.spread(d, "items", limit=1).columns == ["id", "items_1"]


def test_fold_and_pivot(spark):
    d = spark.createDataFrame([(1, 10, None), (2, 30, 40)], "id int, x int, y int")
    folded = op.fold(d, ["x", "y"])
    assert sorted_rows(folded) == [(1, "x", 10), (1, "y", None), (2, "x", 30), (2, "y", 40)]
    assert sorted_rows(op.pivot(folded, ["id"], "key", "value")) == [(1, 10.0, None), (2, 30.0, 40.0)]
    assert op.pivot(folded, [], "key", "value", "count").collect()[0].asDict() == {"x": 2, "y": 2}
    mixed = spark.createDataFrame([(1, 2, "z")], "id int, a int, b string")
    assert sorted_rows(op.fold(mixed, ["a", "b"])) == [(1, "a", "2"), (1, "b", "z")]


def test_pivot_keys(spark):
    d = spark.createDataFrame([("r", "b", 1), ("r", "a", 2), ("s", None, 3), ("s", "c", 4)], "r string, k string, v int")
    assert op.pivot(d, ["r"], "k", "v", limit=2).columns == ["r", "a", "b"]
    assert sorted_rows(op.pivot(d, ["r"], "k", "v", limit=2)) == [("r", 2.0, 1.0), ("s", None, None)]
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError, match="more than 2"):
            op.pivot(d, ["r"], "k", "v")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_rank_ties(spark):
    d = spark.createDataFrame([(100,), (90,), (90,), (80,)], "score int")
    out = op.window(d, {"r": "rank", "d": "dense_rank", "a": "avg_rank"}, [("score", "desc")])
    assert sorted(rows(out), reverse=True) == [(100, 1, 1, 1.0), (90, 2, 2, 2.5), (90, 2, 2, 2.5), (80, 4, 3, 4.0)]


def test_rolling_sum(spark):
    d = spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "day int, value int")
    out = op.window(d, {"s": ("sum", "value")}, "day", frames={"s": (-2, 0)})
    assert [r[2] for r in sorted(rows(out))] == [10, 30, 60, 90, 120]
    with pytest.raises(ValueError, match="not derived"):
        op.window(d, {"s": ("sum", "value")}, "day", frames={"t": (-2, 0)})


def test_imputation(spark):
    d = spark.createDataFrame([(1, 10.0), (2, None), (3, 20.0), (4, None), (5, 30.0)], "id int, val double")
    for method, want in (("mean", 20.0), ("median", 20.0), ("min", 10.0), ("max", 30.0)):
        assert {r[1] for r in rows(op.impute(d, "val", method)) if r[0] in (2, 4)} == {want}
    fill = {m: [r[1] for r in sorted(rows(op.impute(d, "val", m, order_by="id")))] for m in ("forwardFill", "backwardFill")}
    assert fill == {"forwardFill": [10, 10, 20, 20, 30], "backwardFill": [10, 20, 20, 30, 30]}
    gap = spark.createDataFrame([(1, None), (2, 10), (3, None), (4, None), (5, 40), (6, None)], "i int, v int")
    assert [r[1] for r in sorted(rows(op.impute(gap, "v", "linearInterpolation", order_by="i")))] == [None, 10, 20, 30, 40, None]
    text = spark.createDataFrame([("a",), ("",), (None,)], "t string")
    assert rows(op.impute(text, "t", "constant", "z", include_empty=True)) == [("a",), ("z",), ("z",)]
    assert rows(op.impute(text, "t", "mean")) == [("a",), ("",), (None,)]
    with pytest.raises(ValueError, match="order_by"):
        op.impute(d, "val", "forwardFill")


def test_concat_and_union(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(True,)], "c boolean")
    assert sorted_rows(op.concat(a, b)) == [(None, None), (1, "x")]
    c = spark.createDataFrame([(1.5, "x"), (1.0, "x")], "a double, b string")
    assert op.concat(a, c).schema["a"].dataType == T.DoubleType()
    assert sorted_rows(op.union(a, c)) == [(1.0, "x"), (1.5, "x")]


def test_dedupe(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "k", "c"), (4, "k", "d"), (5, "z", "e")], "id int, g string, v string")
    assert sorted_rows(op.dedupe(d, ["g"], order_by="id")) == [(1, None, "a"), (3, "k", "c"), (5, "z", "e")]
    assert sorted_rows(op.dedupe(d, ["g"], order_by=[("id", "desc")])) == [(2, None, "b"), (4, "k", "d"), (5, "z", "e")]
    assert [r[0] for r in sorted_rows(op.dedupe(d, ["g"], mode="keep"))] == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="order_by"):
        op.dedupe(d, ["g"])


def test_promote_header(spark):
    d = spark.createDataFrame([(1, "junk", None), (2, " id ", ""), (3, "5", "x")], "n int, a string, b string")
    out = op.promote_header(d, "n", skip=1)
    assert out.columns == ["2", "id", "Column 3"] and rows(out) == [(3, "5", "x")]
    with pytest.raises(ValueError, match="no row 9"):
        op.promote_header(d, "n", skip=9)


def test_columns_by_pattern(spark):
    d = spark.createDataFrame([(1, 2, 3)], "a_x int, b_x int, c int")
    assert op.select_pattern(d, "_x", "suffix", ["c"]).columns == ["a_x", "b_x", "c"]
    assert op.select_pattern(d, "zzz", "contains").columns == d.columns
    assert op.select_pattern(d, "[", "regex").columns == d.columns
    assert op.remove_pattern(d, "", "prefix").columns == []
    assert op.rename_pattern(d, "_", "__").columns == ["a__x", "b__x", "c"]
    assert op.rename_pattern(d, "(.)_x", "$1$1", regex=True).columns == ["aa", "bb", "c"]
    assert op.rename_pattern(d, "(", "y", regex=True).columns == d.columns
    with pytest.raises(ValueError, match="overwrite"):
        op.rename(d, {"c": "a_x"})


def test_copies_are_drawn_independently(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1.0)] * 50 + [("b", None)] * 50 + [("c", 2.0)], "t string, x double")
    drawn = sorted_rows(op.sample(df, 50, seed=5))
    assert len(drawn) == 50 and {"a", "b"} <= {r[0] for r in drawn} and all(sum(r == d for r in drawn) <= 50 for d in drawn)
    assert drawn == sorted_rows(op.sample(df.repartition(7), 50, seed=5))
    assert sorted_rows(op.sample(df, 500, seed=5)) == sorted_rows(df)
    monkeypatch.setattr("tablewright.operators.rows.COPIES", 8)
    assert drawn == sorted_rows(op.sample(df, 50, seed=5))
    assert op.sample(df.limit(0), 5, seed=1).count() == 0 and op.sample(df, 0, seed=1).count() == 0
    nested = df.withColumn("m", F.create_map("t", "x"))
    assert op.sample(nested, 60, seed=2).count() == 60


def test_sample(tables):
    a = sorted_rows(op.sample(tables.orders, 100, seed=1))
    assert a == sorted_rows(op.sample(tables.orders.repartition(5), 100, seed=1)) != sorted_rows(op.sample(tables.orders, 100, seed=2))
    assert op.sample(tables.orders, 10**6, seed=1).count() == tables.orders.count()
    assert op.sample(tables.nation, 7).count() == 7


def test_profiles(spark):
    d = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",), ("c",)], "v string")
    got = [(r["value"], r["count"]) for r in op.categorical_profile(d, "v", top=2).orderBy("position").collect()]
    assert got == [("a", 2), ("b", 1), ("Other (1)", 1), ("(null)", 2)]
    one = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert rows(op.histogram(one, "v"), "bin", "count") == [(0, 2)]
    numbers = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "v string")
    p = op.numeric_profile(numbers, ["v"]).first()
    assert (p["total_count"], p["null_count"], p["min"], p["max"], p["median"], p["unique_count"]) == (4, 1, 1.0, 2.0, 1.5, 3)
    rough = op.numeric_profile(numbers, ["v"], accuracy="approx").first()
    assert (rough["min"], rough["max"], rough["unique_count"]) == (1.0, 2.0, 3)
    every = op.profile(d.withColumn("n", F.lit(1)))
    assert every["numeric"].count() == 1 and list(every["categorical"]) == ["v"]


def test_temporal_units(spark):
    for end, unit in (("2027-01-01", "month"), ("2024-06-01", "day"), ("2024-01-05", "day"), ("2024-01-02", "minute")):
        d = spark.createDataFrame([("2024-01-01",), (end,)], "t string").selectExpr("cast(t as timestamp_ntz) t")
        assert op.temporal_unit(d, "t") == unit


def test_streams_are_refused_where_order_matters(spark, tmp_path):
    stream = spark.readStream.schema("id long, v double").parquet(str(tmp_path))
    assert op.derive(op.filter_value(stream, "v", ">", 1.0), {"w": fn.round_("v")}).isStreaming
    for act in (lambda: op.sort(stream, "id"), lambda: op.add_index(stream, "i", "id"), lambda: op.window(stream, {"r": "rank"}, "id")):
        with pytest.raises(ValueError, match="streaming"):
            act()


def test_awkward_column_names(spark, tiny_groups):
    d = spark.range(60).selectExpr("id as `a.b`", "id % 3 as `k y`", "cast(id % 7 as double) as `v``q`")
    out = op.window(d, {"r.k": "rank", "s m": ("sum", "v`q"), "f": ("fill_down", "v`q"), "t": ("max", "a.b")}, "v`q", ["k y"], {"t": (None, None)})
    assert out.columns == ["a.b", "k y", "v`q", "r.k", "s m", "f", "t"] and out.count() == 60
    whole = op.window(d, {"r.k": "dense_rank", "n": ("count", None)}, "a.b")
    assert sorted(r["n"] for r in whole.collect()) == list(range(1, 61))
    assert op.aggregate(d, {"m d": ("median", "v`q"), "n.n": "count"}, ["k y"]).count() == 3
    assert op.join(d, d.select("`a.b`", "`k y`"), "a.b", "full").columns == ["a.b", "k y_x", "v`q", "k y_y"]
    assert op.dedupe(d, ["k y"], order_by="a.b").count() == 3
    assert op.fold(d, ["a.b", "k y"]).select("key").distinct().count() == 2
    assert op.slice_rows(d, 5, "removeFirst", "a.b").count() == 55
