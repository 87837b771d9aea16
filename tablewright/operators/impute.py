"""Filling missing cells: by a constant, a statistic, or neighbours in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import num, value
from ..functions.logic import ERROR_SUFFIX
from ..plans.layout import CNT, RN, hot_groups, number_large
from ..plans.names import Order, UniqueOrder, ref, require_columns, total_order
from ..streaming import require_batch
from .aggregate import aggregate
from .window import Spec, block_windows, plain_windows, window

STATISTICS = ("mean", "median", "min", "max")
NEIGHBOUR = ("forwardFill", "backwardFill", "linearInterpolation")
METHODS = ("constant", *STATISTICS, *NEIGHBOUR)


def missing(df: DataFrame, column: str, include_empty: bool = False) -> Column:
    """Null, NaN, a failed conversion, and optionally empty text."""
    c, kind = ref(column), df.schema[column].dataType
    result = c.isNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        result = result | F.isnan(c)
    if column + ERROR_SUFFIX in df.columns:
        result = result | ref(column + ERROR_SUFFIX).isNotNull()
    if include_empty and isinstance(kind, T.StringType):
        result = result | (c == "")
    return result


def impute(
    df: DataFrame,
    column: str,
    method: str,
    constant=None,
    order_by: Order | None = None,
    include_empty: bool = False,
) -> DataFrame:
    """The column without its missing cells, where the method finds a value.

    Statistics use numeric cells only and leave the cell null when there are
    none; they reach the rows as a scalar subquery. Neighbour methods need
    ``order_by`` and leave cells without a neighbour null.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    require_columns(df, [column])
    gone = missing(df, column, include_empty)
    if method == "constant":
        return _filled(df, column, F.when(gone, value(constant)).otherwise(ref(column)))
    require_batch(df, f"impute {method}")
    if method in STATISTICS:
        numbers = df.select(F.when(~gone, num(ref(column))).alias("v"))
        found = aggregate(numbers, {"s": (method, "v")}, round_digits=None).scalar()
        return _filled(df, column, F.when(gone, _same_type(df, column, found)).otherwise(ref(column)))
    if order_by is None:
        raise ValueError(f"{method} depends on row order: pass order_by")
    kept = df.withColumn("__kept", F.when(~gone, ref(column)))
    if method in ("forwardFill", "backwardFill"):
        fn = "fill_down" if method == "forwardFill" else "fill_up"
        full = window(kept, {"__full": (fn, "__kept")}, _without_helper(df, order_by))
        return _filled(full, column, F.col("__full")).select(*[ref(c) for c in df.columns])
    return _interpolated(kept, column, _without_helper(df, order_by), df.columns)


def _without_helper(df: DataFrame, order_by: Order) -> UniqueOrder:
    """The total order of the original columns, so helper columns never decide ties."""
    return UniqueOrder((n, "desc" if d else "asc") for n, d in total_order(df, order_by))


def _filled(df: DataFrame, column: str, c: Column) -> DataFrame:
    """Sets the column; a filled cell is no longer failed."""
    error = column + ERROR_SUFFIX
    if error in df.columns:
        df = df.withColumn(error, F.when(c.isNull(), ref(error)))
    return df.withColumn(column, c)


def _same_type(df: DataFrame, column: str, c: Column) -> Column:
    """A number for a numeric column, its text for a text column."""
    return c.cast("string") if isinstance(df.schema[column].dataType, T.StringType) else c


def _interpolated(kept: DataFrame, column: str, order_by, columns) -> DataFrame:
    """Between the nearest numeric neighbours, by row position."""
    hot = hot_groups(kept, [])
    if hot is None:
        numbered = plain_windows(kept, [Spec(RN, "row_number")], order_by, []).withColumn(CNT, F.lit(None).cast("long"))
    else:
        numbered = number_large(kept, [], order_by, hot.first()[CNT])
    point = F.when(num(F.col("__kept")).isNotNull(), F.struct(num(F.col("__kept")).alias("v"), F.col(RN).alias("at")))
    numbered = numbered.withColumn("__point", point)
    specs = [Spec("__before", "fill_down", "__point"), Spec("__after", "fill_up", "__point")]
    full = plain_windows(numbered, specs, UniqueOrder([RN]), []) if hot is None else block_windows(numbered, specs, UniqueOrder([RN]), [])
    a, b = F.col("__before"), F.col("__after")
    between = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col(RN) - a["at"], b["at"] - a["at"])
    kind = kept.schema[column].dataType
    guess = between.cast("string") if isinstance(kind, T.StringType) else between
    result = F.when(F.col("__kept").isNotNull(), F.col("__kept")).otherwise(guess)
    return _filled(full, column, result).select(*[ref(c) for c in columns])
