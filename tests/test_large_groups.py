"""The forms for groups larger than a task give what the one-task forms give."""

import statistics
from importlib import import_module

import pytest
from helpers import sorted_rows
from pyspark.sql import functions as F

from tablewright import UniqueOrder
from tablewright import operators as op
from tablewright.plans.layout import HOT_ROWS_CONF

FRAMES = [(-2, 0), (0, 3), (-1, 1), (None, 0), (0, None), (None, -2), (None, 3), (2, None), (-3, None), (None, None), (1, 4), (-5, -2)]


@pytest.fixture
def skewed(spark):
    """One key holds most rows, some are small, one is null; values have gaps and ties."""
    base = spark.range(0, 500, 1, 7).select(
        F.col("id"),
        F.when(F.col("id") % 5 < 3, F.lit("hot")).when(F.col("id") % 5 == 3, F.concat(F.lit("k"), (F.col("id") % 30).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 503).alias("o"),
        (F.floor(F.col("id") / 60)).alias("peer"),
        F.when(F.col("id") % 4 > 0, (F.col("id") * 31 % 17).cast("double")).alias("v"),
        F.when((F.col("id") < 100) | (F.col("id") > 300), F.col("id").cast("string")).alias("t"),
    )
    return base


def both(spark, build):
    plain = sorted_rows(build())
    spark.conf.set(HOT_ROWS_CONF, "100")
    try:
        large = sorted_rows(build())
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    return plain, large


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_ranking(spark, skewed, keys):
    fns = {"a": "row_number", "b": "rank", "c": "dense_rank", "d": "avg_rank", "e": "percent_rank", "f": "cume_dist", "h": ("ntile", 7)}
    plain, large = both(spark, lambda: op.window(skewed, fns, "peer", keys))
    assert plain == large


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_ranking_descending(spark, skewed, keys):
    fns = {"a": "row_number", "b": "rank", "c": "dense_rank", "h": ("ntile", 13)}
    plain, large = both(spark, lambda: op.window(skewed, fns, [("v", "desc"), "o"], keys))
    assert plain == large


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_positional(spark, skewed, keys):
    fns = {
        "a": ("lag", "v"), "b": ("lag", "t", 3, "none"), "c": ("lead", "v", 2), "d": ("lead", "o", 60, -1), "e": ("first_value", "t"),
        "f": ("last_value", "v"), "h": ("nth_value", "t", 5), "i": ("nth_value", "t", 9999), "j": ("fill_down", "t"), "k": ("fill_up", "t"), "l": ("fill_down", "v"),
    }
    plain, large = both(spark, lambda: op.window(skewed, fns, "id", keys))
    assert plain == large


@pytest.mark.parametrize("position, frame", list(enumerate(FRAMES)))
def test_frames(spark, skewed, position, frame):
    fns = {
        "a": ("sum", "v"), "b": ("mean", "v"), "c": ("min", "o"), "d": ("max", "t"), "e": ("count", None), "f": ("stdev", "v"),
        "h": ("variance", "v"), "j": ("mode", "v"),
    }
    if None not in frame or frame == (None, None):
        fns["i"] = ("median", "v")
    frames = {k: frame for k in fns}
    keys = [] if position % 2 else ["g"]
    plain, large = both(spark, lambda: op.window(skewed, fns, "o", keys, frames))
    assert plain == large


@pytest.mark.parametrize("frame", [(None, 0), (None, -2), (None, 3), (0, None), (2, None), (-3, None)])
def test_half_unbounded_median_and_mode(spark, skewed, frame):
    out = op.window(skewed, {"m": ("median", "v"), "q": ("mode", "v"), "n": ("count", "v")}, "o", ["g"], {k: frame for k in "mqn"})
    got = {r["id"]: (r["m"], r["q"]) for r in out.collect()}
    groups = {}
    for r in skewed.orderBy("o").collect():
        groups.setdefault(r["g"], []).append(r)
    lo, hi = frame
    for members in groups.values():
        for i, r in enumerate(members):
            window = members[0 if lo is None else max(i + lo, 0) : len(members) if hi is None else max(i + hi + 1, 0)]
            values = [w["v"] for w in window if w["v"] is not None]
            median = statistics.median(values) if values else None
            mode = min(values, key=lambda v: (-values.count(v), v)) if values else None
            assert got[r["id"]] == (median, mode)


def test_half_unbounded_median_has_no_largest_group(spark, skewed):
    """The default frame, in groups below and far above the limit of rows."""
    plain, large = both(spark, lambda: op.window(skewed, {"m": ("median", "v")}, "o", ["g"]))
    assert plain == large and len(plain) == 500


@pytest.mark.parametrize("position, frame", list(enumerate([(None, 0), (None, -2), (None, 3), (0, None), (2, None), (-3, None), (None, 900)])))
def test_half_unbounded_median_of_large_groups(spark, skewed, position, frame):
    keys = [] if position % 2 else ["g"]
    plain, large = both(spark, lambda: op.window(skewed, {"m": ("median", "v"), "n": ("count", "v")}, "o", keys, {k: frame for k in "mn"}))
    assert plain == large and len(plain) == 500


@pytest.mark.parametrize("value", ["id", "-id", "3", "case when id < 60 then 100 else 1000 * (id % 2) + id end", "cast(null as double)", "if(id % 3 = 0, double('nan'), id % 7)"])
def test_running_median_of_awkward_large_values(spark, value):
    d = spark.range(0, 400, 1, 5).selectExpr("id", f"{value} as v")
    plain, large = both(spark, lambda: op.window(d, {"m": ("median", "v")}, UniqueOrder(["id"])))
    assert plain == large and len(plain) == 400


def test_running_median_blocks_hold_few_rows_in_python(spark, skewed, monkeypatch):
    """A group far below the hot limit is cut into blocks too; keys of any type come back, and a frame without values is null."""
    module = import_module("tablewright.operators.window")
    d = skewed.withColumns({"day": F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 2 as int))"), "d": F.expr("if(id % 2 = 0, null, 1.50bd)")})
    d = d.withColumn("v", F.when(F.col("o") > 90, F.col("v")))
    build = lambda: op.window(d, {"m": ("median", "v")}, "o", ["day", "d"])
    plain = sorted_rows(build())
    monkeypatch.setattr(module, "MEDIAN_ROWS", 60)
    sizes = []
    blocks = module._block_medians
    monkeypatch.setattr(module, "_block_medians", lambda *args: sizes.append(module.median_rows(args[0])) or blocks(*args))
    assert sorted_rows(build()) == plain and sizes == [60] and any(r[-1] is None for r in plain)


def test_running_median_has_no_cross_join(spark, skewed, tiny_groups, monkeypatch):
    module = import_module("tablewright.operators.window")
    needs = []
    find = module._median_buckets
    monkeypatch.setattr(module, "_median_buckets", lambda *args: needs.append(find(*args)) or needs[-1])
    op.window(skewed, {"m": ("median", "v")}, "o")
    plan = needs[0]._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and needs[0].count() > 50


def test_percentiles_outside_their_brackets_are_found(spark, monkeypatch):
    """Without a margin and with a coarse sketch the first brackets miss."""
    module = import_module("tablewright.operators.aggregate")
    monkeypatch.setattr(module, "SKETCH_ACCURACY", 5)
    d = spark.range(0, 3000, 1, 7).selectExpr("id % 3 as g", "cast(pow(id, 1.5) as double) as __v", "1000L as __cnt")
    passes = []
    narrowed = module._narrowed
    monkeypatch.setattr(module, "_narrowed", lambda *args: passes.append(args) or narrowed(*args))
    got = {r[0]: tuple(r)[1:] for r in module._narrowed(d, ["g"], [0.5, 0.25], 1000, 0.0).collect()}
    want = {r[0]: tuple(r)[1:] for r in module._buffered(d, ["g"], [0.5, 0.25]).collect()}
    assert len(passes) > 1 and got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_percentiles_with_more_cells_than_the_hot_limit(spark, tiny_groups, monkeypatch, keys):
    """A wide bracket keeps so many different values that their running sum is itself a large group."""
    module = import_module("tablewright.operators.aggregate")
    monkeypatch.setattr(module, "SKETCH_ACCURACY", 20)
    d = spark.range(0, 3000, 1, 7).selectExpr("id % 3 as g", "cast(pow(id, 1.5) as double) as v")
    got = sorted_rows(op.aggregate(d, {"m": ("median", "v")}, keys))
    want = d.groupBy(*keys).agg(F.percentile("v", F.lit(0.5)).alias("m"))
    assert got == sorted_rows(want)


def test_range_partitions_do_not_follow_a_low_limit(spark, tiny_groups, monkeypatch):
    """Bounds are sampled to the driver by the partition: one per 40 rows would send it more rows than the table has."""
    layout = import_module("tablewright.plans.layout")
    assert layout.range_partitions(spark, 36_000_000) == 18
    out = layout.number_large(spark.range(0, 5000, 1, 3), [], UniqueOrder(["id"]), 5000)
    assert out.filter(F.col("__rn") != F.col("id") + 1).isEmpty() and out.count() == 5000
    written = []
    stage = layout.stage
    monkeypatch.setattr(layout, "stage", lambda df: written.append(df.rdd.getNumPartitions()) or stage(df))
    layout.laid_out(spark.range(0, 5000, 1, 3), [("id", False)], 5000)
    assert written == [4]


def test_running_product(spark, skewed):
    d = skewed.withColumn("w", 1 + F.col("v") / 1000)
    plain, large = both(spark, lambda: op.window(d, {"p": ("product", "w")}, "o"))
    assert plain == large


def test_buffered_aggregates(spark, skewed):
    rollup = {"m": ("median", "v"), "q": ("mode", "t"), "w": ("mode", "v"), "n": "count", "s": ("sum", "v"), "l": ("last", "t")}
    for keys in ([], ["g"]):
        plain, large = both(spark, lambda: op.aggregate(skewed, rollup, keys, order_by="o"))
        assert plain == large


def test_all_null_large_group(spark):
    d = spark.range(100).select(F.lit("x").alias("g"), F.lit(None).cast("double").alias("v"), "id")
    plain, large = both(spark, lambda: op.aggregate(d, {"m": ("median", "v"), "q": ("mode", "v"), "n": "count"}, ["g"]))
    assert plain == large == [("x", None, None, 100)]


@pytest.mark.parametrize("mode", ["first", "last", "removeFirst", "removeLast"])
@pytest.mark.parametrize("order", ["id", "peer", [("v", "desc"), "t"]])
def test_slices(spark, skewed, mode, order):
    for count in (0, 1, 57, 500, 900):
        plain, large = both(spark, lambda: op.slice_rows(skewed, count, mode, order))
        assert plain == large
        assert len(plain) == (min(count, 500) if mode in ("first", "last") else max(500 - count, 0))


def test_slice_with_identical_rows(spark):
    d = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,)], "a int")
    for mode, want in (("removeFirst", [1, 2, 2]), ("removeLast", [1, 1, 1])):
        got = [r[0] for r in op.slice_rows(d, 2, mode, "a").collect()]
        assert sorted(got) == want


def test_positions(spark, skewed):
    for build in (
        lambda: op.add_index(skewed, "i", "o", start=5),
        lambda: op.keep_rows(skewed, [0, 3, 499, 600], "o"),
        lambda: op.remove_rows(skewed, [0, 3, 499, 600], "o"),
        lambda: op.sample(skewed, 120, seed=4),
    ):
        plain, large = both(spark, build)
        assert plain == large


@pytest.mark.parametrize("method", ["forwardFill", "backwardFill", "linearInterpolation"])
def test_neighbour_imputation(spark, skewed, method):
    for column in ("v", "t"):
        plain, large = both(spark, lambda: op.impute(skewed, column, method, order_by="o"))
        assert plain == large


def test_profile_quartiles(spark, skewed):
    plain, large = both(spark, lambda: op.numeric_profile(skewed, ["v", "o", "id"]))
    assert plain == large


def test_large_top_n(spark, skewed, monkeypatch):
    from tablewright.plans import layout

    want = sorted_rows(op.slice_rows(skewed, 200, "last", "o"))
    first = sorted_rows(op.slice_rows(skewed, 200, "first", "o"))
    monkeypatch.setattr(layout, "TOP_ROWS", 10)
    plain, large = both(spark, lambda: op.slice_rows(skewed, 200, "last", "o"))
    assert plain == large == want
    plain, large = both(spark, lambda: op.slice_rows(skewed, 200, "first", "o"))
    assert plain == large == first


def test_partition_invariance(spark, skewed):
    builds = [
        lambda d: op.add_index(d, "i", "peer"),
        lambda d: op.sample(d, 50, seed=9),
        lambda d: op.dedupe(d, ["peer"], order_by="v"),
        lambda d: op.lookup(d, d.select("peer", F.col("t").alias("t2")), ["peer"], ["t2"], order_by="t2"),
        lambda d: op.window(d, {"a": ("lag", "v"), "b": ("fill_down", "t")}, "peer", ["g"]),
    ]
    for build in builds:
        assert sorted_rows(build(skewed.coalesce(1))) == sorted_rows(build(skewed.repartition(8)))
