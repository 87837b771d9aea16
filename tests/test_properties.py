"""Laws that hold on any table, checked on generated and on driver tables."""

import pytest
from helpers import sorted_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright import UniqueOrder
from tablewright import operators as op

number = st.one_of(st.none(), st.integers(-100, 100))
table = st.lists(st.tuples(st.sampled_from(["Cat", "Dog", "Fox", None]), number), min_size=1, max_size=20)
few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, data):
    return spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "id int, g string, v int")


@few
@given(data=table, threshold=st.integers(-100, 100))
def test_filter_splits_the_table(spark, data, threshold):
    d = frame(spark, data)
    above, below = op.filter_value(d, "v", ">", threshold), op.filter_value(d, "v", "<=", threshold)
    assert above.count() + below.count() + op.filter_value(d, "v", "is_null").count() == len(data)
    assert sorted_rows(op.filter_value(above, "v", ">", threshold)) == sorted_rows(above)


@few
@given(data=table)
def test_groups_add_up(spark, data):
    d = frame(spark, data)
    groups = op.aggregate(d, {"n": "count", "s": ("sum", "v")}, ["g"]).collect()
    assert sum(r["n"] for r in groups) == len(data)
    assert sum(r["s"] or 0 for r in groups) == sum(v or 0 for _, v in data)
    assert len(groups) == len({g for g, _ in data})


@few
@given(data=table, other=st.lists(st.sampled_from(["Cat", "Dog", "Cow", None]), max_size=5))
def test_semi_and_anti_join_split_the_left_table(spark, data, other):
    d, right = frame(spark, data), spark.createDataFrame([(g,) for g in other], "g string")
    assert sorted_rows(op.semijoin(d, right, "g").unionByName(op.antijoin(d, right, "g"))) == sorted_rows(d)
    assert op.lookup(d, right.withColumn("w", F.lit(1)), "g", ["w"], order_by="w").count() == len(data)


@few
@given(data=table)
def test_window_totals(spark, data):
    d = frame(spark, data)
    out = op.window(d, {"run": ("sum", "v"), "all": ("sum", "v"), "rn": "row_number"}, UniqueOrder(["id"]), ["g"], {"all": (None, None)})
    totals = {r["g"]: r["s"] for r in op.aggregate(d, {"s": ("sum", "v")}, ["g"]).collect()}
    last = {}
    for r in sorted(out.collect(), key=lambda r: r["id"]):
        assert r["all"] == totals[r["g"]]
        last[r["g"]] = r
    assert all(r["run"] == totals[g] and r["rn"] == sum(1 for x, _ in data if x == g) for g, r in last.items())


@few
@given(data=st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=10))
def test_pivot_undoes_fold(spark, data):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, x int, y int, z int")
    back = op.pivot(op.fold(d, ["x", "y", "z"]), ["id"], "key", "value", "max")
    assert sorted_rows(back, "id", "x", "y", "z") == sorted_rows(d)


def test_idempotence(tables):
    d = tables.orders
    twice = [
        lambda x: op.sort(x, "o_custkey"), lambda x: op.slice_rows(x, 20, "first", "o_orderkey"), lambda x: op.dedupe(x),
        lambda x: op.dedupe(x, ["o_custkey"], order_by="o_orderkey"), lambda x: op.types(x, {"o_totalprice": "float"}), lambda x: op.select(x, ["o_orderkey"]),
    ]
    for act in twice:
        once = act(d)
        assert sorted_rows(act(once)) == sorted_rows(once)


@pytest.mark.parametrize("count", [0, 1, 99])
def test_slices_split_the_table(tables, count):
    order = ["o_custkey", ("o_orderdate", "desc")]
    for keep, drop in (("first", "removeFirst"), ("last", "removeLast")):
        parts = op.slice_rows(tables.orders, count, keep, order).unionByName(op.slice_rows(tables.orders, count, drop, order))
        assert sorted_rows(parts) == sorted_rows(tables.orders)


def test_unique_order_reads_only_its_columns(tables):
    out = op.window(tables.events, {"p": ("lag", "value")}, UniqueOrder(["event_id"]), ["user_id"]).select("event_id", "p")
    assert "props" not in out._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    loose = op.window(tables.events, {"p": ("lag", "value")}, ["event_id"], ["user_id"]).select("event_id", "p")
    assert sorted_rows(out) == sorted_rows(loose)
    for mode in ("removeFirst", "removeLast"):
        a = op.slice_rows(tables.events, 30, mode, UniqueOrder(["event_id"]))
        assert sorted_rows(a) == sorted_rows(op.slice_rows(tables.events, 30, mode, ["event_id"]))


def test_filters_reach_the_scan(tables):
    plan = op.filter_value(tables.orders, "o_totalprice", ">", 1.0).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_range_layout_survives_reexecution(spark, tables, tiny_groups):
    numbered = op.add_index(tables.orders, "i", "o_orderdate")
    first = sorted_rows(numbered, "o_orderkey", "i")
    assert first == sorted_rows(numbered, "o_orderkey", "i")
    assert sorted(i for _, i in first) == list(range(1, len(first) + 1))
