"""Group aggregation and table description.

Everything is built from aggregates that combine on the map side, so one key may
hold any share of the rows. ``mode`` and ``median`` are the exceptions in Spark
(one buffer with every distinct value of the group); for groups above the hot
limit they are computed from value counts and from bracketed ranks instead.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.layout import CNT, attach, hot_groups, hot_limit, side_by_side, split_hot, stage
from ..plans.names import Order, order_items, ref, require_columns, require_free, total_order
from ..streaming import require_batch

SKETCH_ACCURACY = 10_000  # a sketch is off by at most one in this many ranks

BUFFERED = ("mode", "median")
ORDERED = ("first", "last", "array_agg")
SIMPLE = (
    "count", "valid", "invalid", "distinct", "sum", "mean", "average", "min", "max", "stdev", "variance", "stdevp",
    "variancep", "product", "any", "array_agg_distinct",
)
FUNCTIONS = (*SIMPLE, *BUFFERED, *ORDERED)


def present(df: DataFrame, name: str) -> Column:
    """The value with NaN as missing."""
    return F.nanvl(ref(name), F.lit(None)) if _is_floating(df, name) else ref(name)


def _is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def round_result(x: Column, digits: int | None = 9) -> Column:
    """Half up at a decimal place; values beyond exact doubles pass unchanged."""
    if digits is None:
        return x
    scale = F.lit(float(10**digits))
    return F.when(F.abs(x * scale) < float(2**53), F.floor(x * scale + 0.5) / scale).otherwise(x)


def _number(df: DataFrame, name: str) -> Column:
    c = present(df, name)
    return c if is_numeric(df, name) and _is_floating(df, name) else c.try_cast("double")


def aggregate_column(df: DataFrame, fn: str, name: str | None, approx: bool = False) -> Column:
    """One built-in aggregate over a column."""
    if fn == "count":
        return F.count(F.lit(1))
    c = ref(name)
    if fn == "valid":
        return F.count(present(df, name))
    if fn == "invalid":
        return F.count(F.lit(1)) - F.count(present(df, name))
    if fn == "distinct":
        has_null = F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))
        return (F.approx_count_distinct(c) if approx else F.count_distinct(c)) + has_null
    if fn in ("min", "max"):
        return (F.min if fn == "min" else F.max)(present(df, name))
    if fn == "any":
        return F.any_value(c, True)
    if fn == "array_agg_distinct":
        return F.array_sort(F.collect_set(c))
    if fn == "median":
        return (F.percentile_approx if approx else F.percentile)(_number(df, name), F.lit(0.5))
    if fn == "mode":
        return F.mode(c, deterministic=True)
    n = _number(df, name)
    return {
        "sum": F.sum, "mean": F.avg, "average": F.avg, "stdev": F.stddev_samp, "variance": F.var_samp,
        "stdevp": F.stddev_pop, "variancep": F.var_pop, "product": F.product,
    }[fn](n)


def _order_key(df: DataFrame, order_by: Order | None, fn: str, name: str) -> Column:
    if order_by is None:
        raise ValueError(f"{fn} depends on row order: pass order_by")
    items = total_order(df, order_by, among=[name])
    if any(d for _, d in order_items(order_by)):
        raise ValueError(f"{fn} takes an ascending order_by; use the opposite function for descending")
    return F.struct(*[ref(n) for n, _ in items])


def _ordered_column(df: DataFrame, fn: str, name: str, key: Column) -> Column:
    if fn in ("first", "last"):
        boxed = F.struct(ref(name).alias("v"))
        return (F.min_by if fn == "first" else F.max_by)(boxed, key)["v"]
    pairs = F.sort_array(F.collect_list(F.struct(key.alias("k"), ref(name).alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def aggregate(
    df: DataFrame,
    rollup: dict[str, tuple[str, str | None] | str],
    group_by: Sequence[str] = (),
    order_by: Order | None = None,
    approx: bool = False,
    round_digits: int | None = 9,
) -> DataFrame:
    """One row per group, or one row in all. Null keys form a group.

    ``rollup`` maps an output to ``(function, column)``, or to ``"count"``.
    ``approx`` uses Spark's sketches for distinct and median. ``array_agg``
    builds a value as large as its group, which is what it is for.
    """
    require_batch(df, "aggregate") if order_by or any(_fn(s) in BUFFERED for s in rollup.values()) else None
    if not rollup:
        raise ValueError("rollup must name at least one output")
    keys = list(group_by)
    specs = {out: (_fn(s), None if isinstance(s, str) else s[1]) for out, s in rollup.items()}
    unknown = sorted({f for f, _ in specs.values() if f not in FUNCTIONS})
    if unknown:
        raise ValueError(f"unknown aggregate functions: {unknown}")
    require_columns(df, [*keys, *[c for _, c in specs.values() if c]])
    require_free(specs, keys, "aggregate")

    needs_buffer = {out: s for out, s in specs.items() if s[0] in BUFFERED and not (approx and s[0] == "median")}
    hot = hot_groups(df, keys) if needs_buffer else None
    if hot is None:
        return _one_pass(df, specs, keys, order_by, approx, round_digits)
    if not keys:
        return _in_parts(df, specs, keys, order_by, approx, round_digits, hot)
    cold_rows, hot_rows = split_hot(df, keys, hot)
    return _one_pass(cold_rows, specs, keys, order_by, approx, round_digits).unionByName(
        _in_parts(hot_rows, specs, keys, order_by, approx, round_digits, hot)
    )


def _fn(spec) -> str:
    return spec if isinstance(spec, str) else spec[0]


def _one_pass(df, specs, keys, order_by, approx, round_digits) -> DataFrame:
    """Plain aggregates. Exact distinct counts run beside collected buffers, not with them:

    Spark counts distinct values by grouping by them first, which would keep one
    buffer of every other aggregate per value.
    """
    distinct = {o: s for o, s in specs.items() if s[0] == "distinct" and not approx}
    rest = {o: s for o, s in specs.items() if o not in distinct}
    if distinct and any(fn in (*BUFFERED, *ORDERED, "array_agg_distinct") for fn, _ in rest.values()):
        parts = [_grouped(df, part, keys, order_by, approx, round_digits) for part in (rest, distinct)]
        return side_by_side(parts, keys, list(specs))
    return _grouped(df, specs, keys, order_by, approx, round_digits)


def _grouped(df, specs, keys, order_by, approx, round_digits) -> DataFrame:
    columns = []
    for out, (fn, name) in specs.items():
        if fn in ORDERED:
            c = _ordered_column(df, fn, name, _order_key(df, order_by, fn, name))
        else:
            c = aggregate_column(df, fn, name, approx)
        columns.append(_finish(df, fn, name, c, round_digits).alias(out))
    return df.groupBy(*[ref(k) for k in keys]).agg(*columns)


def _finish(df, fn: str, name: str | None, c: Column, digits: int | None) -> Column:
    numeric = fn in ("sum", "mean", "average", "median", "stdev", "variance", "stdevp", "variancep", "product")
    keeps_type = fn in ("min", "max", "mode", "any", "first", "last") and name and _is_floating(df, name)
    return round_result(c, digits) if numeric or keeps_type else c


def _in_parts(df, specs, keys, order_by, approx, round_digits, hot) -> DataFrame:
    """Large groups: the buffered functions apart, joined on the few group keys."""
    parts = []
    plain = {o: s for o, s in specs.items() if s[0] not in BUFFERED or (approx and s[0] == "median")}
    if plain:
        parts.append(_one_pass(df, plain, keys, order_by, approx, round_digits))
    for out, (fn, name) in specs.items():
        if out not in plain:
            value = large_mode(df, name, keys) if fn == "mode" else large_percentiles(df, name, keys, [0.5], hot)
            source = "mode" if fn == "mode" else "p0"
            parts.append(value.select(*[ref(k) for k in keys], _finish(df, fn, name, F.col(source), round_digits).alias(out)))
    return side_by_side(parts, keys, list(specs))


def large_mode(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Most frequent value, the smallest on a tie, from counts per value."""
    group = [ref(k) for k in keys]
    counts = df.filter(ref(name).isNotNull()).groupBy(*group, ref(name).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min_by(F.struct("__v"), F.struct((-F.col("__n")).alias("n"), F.col("__v")))["__v"].alias("mode")
    everyone = df.groupBy(*group).agg(F.lit(1).alias("__one")) if keys else None
    found = counts.groupBy(*group).agg(best)
    if everyone is None:
        return found
    other = found.select(*[ref(k).alias(f"__m_{k}") for k in keys], "mode")
    cond = functools.reduce(lambda a, b: a & b, [ref(k).eqNullSafe(ref(f"__m_{k}")) for k in keys])
    return everyone.join(other, cond, "left").select(*group, "mode")


def large_percentiles(df: DataFrame, name: str, keys: Sequence[str], ps: Sequence[float], hot: DataFrame) -> DataFrame:
    """Exact interpolated percentiles ``p0, p1, …`` of large groups, without sorting them.

    A sketch of each group brackets every percentile; one more pass counts what
    lies between the brackets and keeps only the values inside them, a few in ten
    thousand, from which the exact ranks are read.
    """
    group = [ref(k) for k in keys]
    values = df.select(*group, _number(df, name).alias("__v")).filter(F.col("__v").isNotNull())
    counts = stage(values.groupBy(*group).agg(F.count(F.lit(1)).alias(CNT)))
    limit = hot_limit(df.sparkSession)
    most, least, few = counts.agg(
        F.max(CNT), F.min(F.when(F.col(CNT) > limit, F.col(CNT))), F.count_if(F.col(CNT) <= limit)
    ).first()
    if not keys:
        return _narrowed(values.withColumn(CNT, F.lit(most)), keys, ps, least) if least else _buffered(values, keys, ps)
    counted = attach(values, counts, keys)
    found = [_narrowed(counted.filter(F.col(CNT) > limit), keys, ps, least)] if least else []
    if few or not found:
        found.append(_buffered(counted.filter(F.col(CNT) <= limit), keys, ps))
    names = [f"p{i}" for i in range(len(ps))]
    return attach(hot.select(*group), functools.reduce(DataFrame.unionByName, found), keys).select(*group, *names)


def _buffered(values: DataFrame, keys: Sequence[str], ps: Sequence[float]) -> DataFrame:
    at = [F.percentile("__v", F.lit(float(p))).alias(f"p{i}") for i, p in enumerate(ps)]
    return values.groupBy(*[ref(k) for k in keys]).agg(*at)


def _narrowed(values: DataFrame, keys: Sequence[str], ps: Sequence[float], fewest: int, margin: float | None = None) -> DataFrame:
    """`large_percentiles` for groups of at least ``fewest`` values, counted in ``__cnt``.

    A sketch keeps its error bound only with high probability. If a percentile lies outside its bracket, the brackets are
    widened and the pass is repeated; the widest go from the smallest value to the largest.
    """
    from .window import window

    group = [ref(k) for k in keys]
    margin = 2 / SKETCH_ACCURACY + 2 / fewest if margin is None else margin
    probes = [F.lit(min(max(p + side * margin, 0.0), 1.0)) for p in ps for side in (-1, 1)]
    sketch = values.groupBy(*group).agg(F.percentile_approx("__v", F.array(*probes), SKETCH_ACCURACY).alias("__q"))
    near = attach(values, sketch, keys) if keys else values.withColumn("__q", sketch.scalar())
    v = F.col("__v")
    brackets = [(F.col("__q")[2 * i], F.col("__q")[2 * i + 1]) for i in range(len(ps))]
    inside = functools.reduce(lambda a, b: a | b, [v.between(lo, hi) for lo, hi in brackets])
    passed = [F.when(hi < v, hi) for _, hi in brackets]
    # Values between brackets become one cell, placed behind the bracket they passed.
    cell = F.when(inside, v).otherwise(F.greatest(*passed) if len(passed) > 1 else passed[0])
    # The window numbers large groups in a `__cnt` of its own, so the count of values goes by another name.
    cells = near.groupBy(*group, F.col(CNT).alias("__all"), cell.alias("__at"), (~inside).alias("__between")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = window(stage(cells), {"__upto": ("sum", "__n")}, ["__at", "__between"], keys)
    exact = F.when(~F.col("__between"), F.col("__at"))
    columns = []
    for i, p in enumerate(ps):
        rank = (F.col("__all") - 1) * F.lit(float(p)) + 1

        def value_at(r: Column) -> Column:
            holds = (F.col("__upto") >= r) & (F.col("__upto") - F.col("__n") < r)
            return F.max(F.when(holds, exact))

        low, high = value_at(F.floor(rank)), value_at(F.ceil(rank))
        columns.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(f"p{i}"))
    found = stage(ranked.groupBy(*group).agg(*columns))
    missed = functools.reduce(lambda a, b: a | b, [F.col(f"p{i}").isNull() for i in range(len(ps))])
    if margin >= 1 or found.filter(missed).isEmpty():
        return found
    return _narrowed(values, keys, ps, fewest, min(1.0, 8 * margin + 1 / SKETCH_ACCURACY))


# Value counts ---------------------------------------------------------------


def value_counts(df: DataFrame, columns: Sequence[str], values: Sequence[Column] | None = None) -> tuple[DataFrame, list[str]]:
    """``(table, keys)``: a row (c, keys …, n) for each value of each column, c being the column's place.

    All columns share one scan and one exchange, and equal values are counted before it. Columns of one type share a
    key column, ``keys[i]`` is that of column i; the other keys are null. A null value is a row without keys.
    """
    values = [ref(c) for c in columns] if values is None else list(values)
    shown = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    kinds = [f.dataType for f in shown.schema.fields]
    distinct = list({k.simpleString(): k for k in kinds}.values())
    keys = [f"k{[d.simpleString() for d in distinct].index(k.simpleString())}" for k in kinds]
    rows = [
        F.struct(F.lit(i).alias("c"), *[(ref(f"v{i}") if keys[i] == f"k{j}" else F.lit(None).cast(d)).alias(f"k{j}") for j, d in enumerate(distinct)])
        for i in range(len(kinds))
    ]
    long = shown.select(F.inline(F.array(*rows)))
    return long.groupBy(*long.columns).agg(F.count(F.lit(1)).alias("n")), keys


# describe -------------------------------------------------------------------

# The statistics of each kind of column.
STATISTICS = {
    "numeric": ("count", "unique", "mean", "median", "stdev", "min", "max"),
    "temporal": ("count", "unique", "min", "max", "top", "freq"),
    "categorical": ("count", "unique", "top", "freq"),
}
STATISTIC_ORDER = ("count", "unique", "top", "freq", "mean", "median", "stdev", "min", "max")


def column_kind(df: DataFrame, name: str) -> str:
    t = df.schema[name].dataType
    if isinstance(t, T.NumericType):
        return "numeric"
    return "temporal" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "categorical"


def value_text(c: Column) -> Column:
    """A result cell as text, since one column of a report mixes types."""
    return c.cast("string")


def describe(df: DataFrame, columns: Sequence[str], as_temporal: Sequence[str] = ()) -> DataFrame:
    """One row per statistic, one text column per described column.

    Two scans: the scalar statistics of all columns come from one, and the distinct and most frequent
    values of all columns from one count per column and value.
    """
    require_batch(df, "describe")
    columns = list(columns)
    if not columns:
        raise ValueError("describe needs at least one column")
    require_columns(df, columns)
    kinds = {c: "temporal" if c in as_temporal else column_kind(df, c) for c in columns}
    stats = [s for s in STATISTIC_ORDER if any(s in STATISTICS[k] for k in kinds.values())]

    rollup: dict[str, tuple[str, str]] = {}
    for i, c in enumerate(columns):
        for s in STATISTICS[kinds[c]]:
            if s not in ("unique", "top", "freq"):
                rollup[f"{i}_{s}"] = ({"count": "valid"}.get(s, s), c)
    counts, keys = value_counts(df, columns)
    found = []
    for i, c in enumerate(columns):
        mine, k = F.col("c") == i, F.col(keys[i])
        found.append(F.count_if(mine).alias(f"{i}_unique"))
        if kinds[c] != "numeric":
            best = F.min_by(F.when(mine & k.isNotNull(), F.struct(k.alias("v"), "n")), F.when(mine & k.isNotNull(), F.struct((-F.col("n")).alias("n"), k.alias("v"))))
            found += [best["v"].alias(f"{i}_top"), F.coalesce(best["n"], F.lit(0)).alias(f"{i}_freq")]
    parts = [aggregate(df, rollup), counts.agg(*found)]
    wide = side_by_side(parts, [], [c for part in parts for c in part.columns])
    rows = [
        F.struct(
            F.lit(s).alias("statistic"),
            *[
                (value_text(F.col(f"{i}_{s}")) if s in STATISTICS[kinds[c]] else F.lit(None).cast("string")).alias(c)
                for i, c in enumerate(columns)
            ],
        )
        for s in stats
    ]
    return wide.select(F.inline(F.array(*rows)))
