"""What plans must look like at scale."""

import re

import pytest

from tablewright import operators as op
from tablewright.plans.layout import laid_out
from tablewright.plans.names import KEY_CHARS, total_order


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataValueLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def range_keys(df):
    return re.findall(r"rangepartitioning\((.*), \d+\)", plan(df))


@pytest.fixture
def texts(spark):
    long = "x" * KEY_CHARS
    rows = [(i % 3, t, i) for i in range(60) for t in (None, "", "a", "B" * (i % 5), long, long + "a", long + "b" * (i % 4), "é" * i)]
    return spark.createDataFrame(rows, "g int, t string, n int").repartition(5)


def python_order(rows, keys):
    for name, down in reversed(keys):
        rows = sorted(rows, key=lambda r: (r[name] is not None, (r[name] if not isinstance(r[name], str) else r[name].encode()) if r[name] is not None else 0), reverse=down)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("by", [["g"], [("g", "desc")], ["t"], [("t", "desc"), ("n", "desc")], ["g", ("t", "desc")]])
def test_sort_by_short_keys(texts, by):
    keys = total_order(texts, by)
    assert [tuple(r) for r in op.sort(texts, by).collect()] == python_order(texts.collect(), keys)
    for part in range_keys(op.sort(texts, by)):
        assert not re.search(r"(^|, )t#\d+ (ASC|DESC)", part)


def test_frequent_values_and_texts_spread(texts):
    sizes = op.sort(texts, ["g"]).rdd.glom().map(len).collect()
    assert max(sizes) < sum(sizes) / 2 or len(sizes) == 1
    laid = laid_out(texts, total_order(texts, ["g"]), 480)
    assert laid.select("__pid").distinct().count() >= 3


def test_no_whole_text_bounds_a_range(tables):
    keys = range_keys(op.sort(tables.documents, "lang"))
    assert keys and all("text#" not in k or "substring(text" in k or "_nondeterministic" in k for k in keys)
    assert "Exchange rangepartitioning(o_custkey" in plan(op.sort(tables.orders.select("o_custkey", "o_orderkey"), "o_custkey"))
