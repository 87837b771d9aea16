"""Column profiles and the aggregations behind charts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import as_ts, num
from ..functions.dates import date_trunc
from ..functions.logic import ERROR_SUFFIX
from ..plans.layout import hot_groups, side_by_side, stage
from ..plans.names import ref, require_columns
from ..streaming import require_batch
from .aggregate import large_percentiles, value_counts
from .rows import sample

# Sizes of the reports.
TOP_VALUES = 5
HISTOGRAM_BINS = 40
SAMPLE_POINTS = 1000
QUARTILES = (0.25, 0.5, 0.75)


def _failed(df: DataFrame, column: str) -> Column:
    name = column + ERROR_SUFFIX
    return ref(name).isNotNull() if name in df.columns else F.lit(False)


def _empty(df: DataFrame, column: str) -> Column:
    c, failed = ref(column), _failed(df, column)
    gone = c.isNull()
    if isinstance(df.schema[column].dataType, T.StringType):
        gone = gone | (c == "")
    return gone & ~failed


def quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of null (or empty) and failed cells, for the columns that have any."""
    require_batch(df, "quality")
    columns = [c for c in (columns or df.columns) if not c.endswith(ERROR_SUFFIX)]
    require_columns(df, columns)
    counts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        counts += [F.count_if(_empty(df, c)).alias(f"null_{i}"), F.count_if(_failed(df, c)).alias(f"error_{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.try_divide(F.col(f"null_{i}") * 100.0, F.col("n")).alias("null_pct"),
            F.try_divide(F.col(f"error_{i}") * 100.0, F.col("n")).alias("error_pct"),
        )
        for i, c in enumerate(columns)
    ]
    return (
        df.agg(*counts).select(F.inline(F.array(*rows))).filter((F.col("null_pct") > 0) | (F.col("error_pct") > 0))
    )


def numeric_profile(df: DataFrame, columns: Sequence[str], accuracy: str = "exact") -> DataFrame:
    """One row per column: counts, range, mean, quartiles, population deviation, 3-sigma bounds.

    Numeric text counts as numbers. Scalars of all columns come from one scan; distinct counts and exact
    quartiles from one count per column and value, summed up along the values. Above the hot limit the
    quartiles come from sketched brackets instead, without sorting the values.
    ``accuracy="approx"`` takes Spark's sketches for quartiles and distinct counts.
    """
    require_batch(df, "numeric_profile")
    require_columns(df, columns)
    hot = hot_groups(df, []) if accuracy == "exact" else None
    values = {i: _finite(df, c) for i, c in enumerate(columns)}
    aggs = [F.count(F.lit(1)).alias("total_count")]
    for i, c in enumerate(columns):
        v = values[i]
        aggs += [
            F.count_if(_empty(df, c)).alias(f"nulls_{i}"),
            F.count_if(_failed(df, c)).alias(f"errors_{i}"),
            F.min(v).alias(f"min_{i}"),
            F.max(v).alias(f"max_{i}"),
            F.avg(v).alias(f"mean_{i}"),
            F.stddev_pop(v).alias(f"std_{i}"),
        ]
        if accuracy != "exact":
            ps = F.array(*[F.lit(p) for p in QUARTILES])
            aggs += [F.percentile_approx(v, ps).alias(f"q_{i}"), F.approx_count_distinct(F.when(~_empty(df, c), ref(c))).alias(f"unique_{i}")]
    parts = [df.agg(*aggs)]
    if accuracy == "exact":
        parts.append(_distinct_and_quartiles(df, columns, hot is None))
    if hot is not None:
        # All columns in one set of passes, as groups of a long table.
        long = df.select(F.posexplode(F.array(*values.values())).alias("c", "v"))
        ids = hot.select(F.explode(F.array(*[F.lit(i) for i in values])).alias("c"))
        quartiles = large_percentiles(long, "v", ["c"], list(QUARTILES), ids)
        q = F.array("p0", "p1", "p2")
        parts.append(quartiles.agg(*[F.any_value(F.when(F.col("c") == i, q), True).alias(f"q_{i}") for i in values]))
    wide = side_by_side(parts, [], [c for part in parts for c in part.columns])

    def percent(c: Column) -> Column:
        return F.try_divide(c * 100.0, F.col("total_count"))

    rows = []
    for i, c in enumerate(columns):
        mean, std, q = F.col(f"mean_{i}"), F.col(f"std_{i}"), F.col(f"q_{i}")
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col("total_count"),
                F.col(f"nulls_{i}").alias("null_count"),
                percent(F.col(f"nulls_{i}")).alias("null_pct"),
                F.col(f"errors_{i}").alias("error_count"),
                percent(F.col(f"errors_{i}")).alias("error_pct"),
                F.col(f"unique_{i}").alias("unique_count"),
                percent(F.col(f"unique_{i}")).alias("unique_pct"),
                F.col(f"min_{i}").alias("min"),
                F.col(f"max_{i}").alias("max"),
                mean.alias("mean"),
                F.get(q, F.lit(0)).alias("p25"),
                F.get(q, F.lit(1)).alias("median"),
                F.get(q, F.lit(2)).alias("p75"),
                std.alias("std"),
                (mean - std * 3).alias("mean_minus_3_sigma"),
                (mean + std * 3).alias("mean_plus_3_sigma"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def _distinct_and_quartiles(df: DataFrame, columns: Sequence[str], quartiles: bool) -> DataFrame:
    """One row: ``unique_i`` and, for tables that fit a task's sort, the interpolated quartiles ``q_i``."""
    counts, keys = value_counts(df, columns, [F.when(~_empty(df, c), ref(c)) for c in columns])
    present = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in sorted(set(keys))])
    counts = counts.filter(present)
    unique = [F.count_if(F.col("c") == i).alias(f"unique_{i}") for i in range(len(columns))]
    if not quartiles:
        return counts.agg(*unique)
    value = reduce(lambda a, k: F.coalesce(a, num(k)), sorted(set(keys)), F.lit(None).cast("double"))
    counts = counts.select("c", F.when(F.abs(value) < float("inf"), value).alias("v"), "n")
    weight = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    column = Window.partitionBy("c")
    ranked = counts.withColumns({"upto": F.sum(weight).over(column.orderBy("v")), "all": F.sum(weight).over(column)})

    def at(rank: Column) -> Column:
        """The first value up to which there are so many; equal values of unlike texts share their sum."""
        return F.min(F.when(F.col("v").isNotNull() & (F.col("upto") >= rank), F.col("v")))

    found = []
    for j, p in enumerate(QUARTILES):
        rank = (F.col("all") - 1) * F.lit(p) + 1
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        found.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(f"p{j}"))
    by = ranked.groupBy("c").agg(F.count(F.lit(1)).alias("unique"), *found)
    q = F.array(*[f"p{j}" for j in range(len(QUARTILES))])
    mine = [F.col("c") == i for i in range(len(columns))]
    return by.agg(
        *[F.coalesce(F.any_value(F.when(m, F.col("unique")), True), F.lit(0)).alias(f"unique_{i}") for i, m in enumerate(mine)],
        *[F.any_value(F.when(m, q), True).alias(f"q_{i}") for i, m in enumerate(mine)],
    )


def _finite(df: DataFrame, column: str) -> Column:
    v = num(ref(column))
    return F.when(~_failed(df, column) & (F.abs(v) < float("inf")), v)


def categorical_profile(df: DataFrame, column: str, top: int = TOP_VALUES) -> DataFrame:
    """The most frequent values, then ``Other (n)``, ``(null)`` and ``Error``.

    Ties go to the smaller value. ``position`` gives the report order. The table
    is read once, into a count per value.
    """
    require_batch(df, "categorical_profile")
    require_columns(df, [column])
    kind = F.when(_failed(df, column), "error").when(_empty(df, column), "null").otherwise("value")
    labels = F.when(kind == "value", ref(column).cast("string"))
    counts = df.groupBy(kind.alias("kind"), labels.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    values = counts.filter(F.col("kind") == "value")
    best = values.orderBy(F.col("count").desc(), F.col("value").asc()).limit(top)
    # The few best values as one sorted array, so that ranks need no window.
    best_rows = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), F.col("value").alias("v")))).alias("b"))
    sums = counts.agg(
        F.sum("count").alias("all"),
        F.coalesce(F.sum(F.when(F.col("kind") == "value", F.col("count"))), F.lit(0)).alias("valued"),
        F.count_if(F.col("kind") == "value").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("kind") == "null", F.col("count"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col("kind") == "error", F.col("count"))), F.lit(0)).alias("errors"),
    )
    report = side_by_side([sums, best_rows], [], [*sums.columns, "b"])
    shown = F.aggregate("b", F.lit(0).cast("long"), lambda acc, x: acc - x["c"])
    report = report.withColumn("shown", shown)

    def line(position: Column, label: Column, count: Column, cls: str) -> Column:
        return F.struct(
            position.cast("int").alias("position"), label.alias("value"), count.cast("long").alias("count"),
            F.lit(cls).alias("kind"),
        )

    tops = F.transform("b", lambda x, i: line(i + 1, x["v"], -x["c"], "value"))
    others = F.array(
        line(F.lit(top + 1), F.concat(F.lit("Other ("), (F.col("distinct") - F.size("b")).cast("string"), F.lit(")")),
             F.col("valued") - F.col("shown"), "other"),
        line(F.lit(top + 2), F.lit("(null)"), F.col("nulls"), "null"),
        line(F.lit(top + 3), F.lit("Error"), F.col("errors"), "error"),
    )
    lines = report.select("all", F.explode(F.concat(tops, F.filter(others, lambda x: x["count"] > 0))).alias("l"))
    return lines.select("l.*", (F.col("l.count") * 100.0 / F.col("all")).alias("pct"))


def categorical_profiles(df: DataFrame, columns: Sequence[str], top: int = TOP_VALUES) -> DataFrame:
    """`categorical_profile` of many columns, with the name in ``column``: one scan, written once as counts per column and value."""
    require_batch(df, "categorical_profiles")
    require_columns(df, columns)
    cells = []
    for c in columns:
        kind = F.when(_failed(df, c), "error").when(_empty(df, c), "null").otherwise("value")
        cells.append(F.struct(kind.alias("kind"), F.when(kind == "value", ref(c).cast("string")).alias("value")))
    counts, keys = value_counts(df, columns, cells)
    counts = stage(counts.select("c", f"{keys[0]}.*", F.col("n").alias("count")))
    order = Window.partitionBy("c").orderBy(F.desc("count"), "value")
    best = counts.filter("kind = 'value'").withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0))
    sums = counts.groupBy("c").agg(F.sum("count").alias("all"), of("value").alias("valued"), F.count_if(F.col("kind") == "value").alias("distinct"), of("null").alias("nulls"), of("error").alias("errors"))
    shown = best.groupBy("c").agg(F.sum("count").alias("shown"), F.count(F.lit(1)).alias("lines"))
    sums = sums.join(shown, "c", "left").fillna(0, ["shown", "lines"])
    rest = [
        (top + 1, F.concat(F.lit("Other ("), (F.col("distinct") - F.col("lines")).cast("string"), F.lit(")")), F.col("valued") - F.col("shown"), "other"),
        (top + 2, F.lit("(null)"), F.col("nulls"), "null"),
        (top + 3, F.lit("Error"), F.col("errors"), "error"),
    ]
    lines = F.array(*[F.struct(F.lit(p).alias("position"), v.alias("value"), n.alias("count"), F.lit(k).alias("kind")) for p, v, n, k in rest])
    others = sums.select("c", "all", F.inline(lines)).filter("count > 0")
    tops = best.join(sums.select("c", "all"), "c").select("c", "all", "position", "value", "count", "kind")
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1).alias("column")
    return tops.unionByName(others).select(name, "position", "value", "count", "kind", (F.col("count") * 100.0 / F.col("all")).alias("pct"))


def profile(df: DataFrame, columns: Sequence[str] | None = None, as_categorical: Sequence[str] = ()) -> dict:
    """``{"numeric": DataFrame | None, "categorical": {column: DataFrame}}`` by column type.

    The lines of all categorical columns come from one scan and are written; each report filters them.
    """
    columns = [c for c in (columns or df.columns) if not c.endswith(ERROR_SUFFIX)]
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType) and c not in as_categorical]
    others = [c for c in columns if c not in numeric]
    lines = stage(categorical_profiles(df, others)) if others else None
    return {
        "numeric": numeric_profile(df, numeric) if numeric else None,
        "categorical": {c: lines.filter(F.col("column") == c).drop("column") for c in others},
    }


def boxplot(df: DataFrame, columns: Sequence[str], accuracy: str = "exact") -> DataFrame:
    """Quartiles and whiskers at 1.5 interquartile ranges, clamped to the data."""
    p = numeric_profile(df, columns, accuracy)
    iqr = F.col("p75") - F.col("p25")
    return p.select(
        "column",
        "min",
        "p25",
        "median",
        "p75",
        "max",
        F.greatest(F.col("min"), F.col("p25") - iqr * 1.5).alias("whisker_low"),
        F.least(F.col("max"), F.col("p75") + iqr * 1.5).alias("whisker_high"),
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins with counts; empty bins are left out. The range is found first."""
    require_batch(df, "histogram")
    require_columns(df, [column])
    values = df.select(_finite(df, column).alias("v")).filter(F.col("v").isNotNull())
    low, high = (F.lit(x).cast("double") for x in values.agg(F.min("v"), F.max("v")).first())
    width = (high - low) / F.lit(bins)
    steps = F.floor(F.try_divide(F.col("v") - low, width))
    bin_of = F.when(width > 0, F.least(steps, F.lit(bins - 1))).otherwise(0)
    counts = values.groupBy(bin_of.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "bin",
        (low + width * F.col("bin")).alias("low"),
        (low + width * (F.col("bin") + 1)).alias("high"),
        "count",
    )


# Spans in days above which a coarser unit is used.
TEMPORAL_UNITS = ((730, "month"), (60, "day"), (2, "day"))
FINEST_UNIT = "minute"


def temporal_unit(df: DataFrame, column: str) -> str:
    """Month above two years, day above two days, else minute."""
    ends = [F.unix_micros(as_ts(edge(ref(column))).cast("timestamp")) for edge in (F.max, F.min)]
    days = (df.agg((ends[0] - ends[1]).alias("span")).first()["span"] or 0) / 86_400_000_000
    return next((unit for limit, unit in TEMPORAL_UNITS if days > limit), FINEST_UNIT)


def temporal_counts(df: DataFrame, column: str, unit: str | None = None) -> DataFrame:
    require_batch(df, "temporal_counts")
    unit = unit or temporal_unit(df, column)
    period = date_trunc(ref(column), unit).alias("period")
    return df.filter(ref(column).isNotNull()).groupBy(period).agg(F.count(F.lit(1)).alias("count"))


def mean_by(df: DataFrame, category: str, column: str) -> DataFrame:
    """Mean and count of the present numbers per category."""
    v = _finite(df, column)
    return (
        df.filter(v.isNotNull() & ref(category).isNotNull())
        .groupBy(ref(category).alias("category"))
        .agg(F.avg(v).alias("mean"), F.count(F.lit(1)).alias("count"))
    )


def mean_over_time(df: DataFrame, time: str, column: str, unit: str | None = None) -> DataFrame:
    require_batch(df, "mean_over_time")
    unit = unit or temporal_unit(df, time)
    v = _finite(df, column)
    return (
        df.filter(v.isNotNull() & ref(time).isNotNull())
        .groupBy(date_trunc(ref(time), unit).alias("period"))
        .agg(F.avg(v).alias("mean"), F.count(F.lit(1)).alias("count"))
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per pair of categories."""
    return (
        df.filter(ref(a).isNotNull() & ref(b).isNotNull())
        .groupBy(ref(a).alias("a"), ref(b).alias("b"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def point_sample(df: DataFrame, columns: Sequence[str], count: int = SAMPLE_POINTS, seed: int | None = None) -> DataFrame:
    """At most ``count`` rows where all the columns are numbers."""
    points = df.select(*[ref(c) for c in columns])
    complete = reduce(lambda x, y: x & y, [_finite(df, c).isNotNull() for c in columns])
    return sample(points.filter(complete), count, seed)
