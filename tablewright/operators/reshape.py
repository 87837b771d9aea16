"""Wide to long, long to wide, and cells to columns or rows.

Where the output's width depends on the data it is found by one small aggregate,
then the result is a fixed projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import quote_regex
from ..plans.names import free_name, ref, require_columns, require_free
from ..streaming import require_batch
from .aggregate import FUNCTIONS, aggregate
from .types import CONVERTERS, LOGICAL_TYPES, physical_type, promote


def fold(df: DataFrame, columns: Sequence[str], names: tuple[str, str] = ("key", "value")) -> DataFrame:
    """One row per cell of the folded columns, nulls included."""
    columns = list(columns)
    require_columns(df, columns)
    ids = [c for c in df.columns if c not in columns]
    require_free(names, ids, "fold")
    kinds = [df.schema[c].dataType for c in columns]
    if len(set(map(str, kinds))) > 1:
        logical = [physical_type(k) for k in kinds]
        both = reduce(promote, logical)
        df = df.withColumns({c: CONVERTERS[both](ref(c), k).cast(LOGICAL_TYPES[both]) for c, k in zip(columns, logical)})
    return df.unpivot([ref(c) for c in ids], [ref(c) for c in columns], names[0], names[1])


def pivot(
    df: DataFrame,
    rows: Sequence[str],
    keys: str,
    values: str,
    aggregation: str = "sum",
    sort: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """One column per key value, one row per combination of ``rows``.

    Null keys make no column. Cells without rows are null. The work is one
    aggregation by rows and key, then a second over its small result.
    """
    require_batch(df, "pivot")
    rows = list(rows)
    require_columns(df, [*rows, keys, values])
    fn = aggregation if aggregation in FUNCTIONS else "any"
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    wanted = min(limit or most + 1, most + 1)
    distinct = df.filter(ref(keys).isNotNull()).select(ref(keys).alias("k")).distinct()
    if sort or limit:  # a limit takes the same keys in every run
        distinct = distinct.orderBy("k")
    names = [r[0] for r in distinct.limit(wanted).select(F.col("k").cast("string")).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} distinct values in {keys}: pass limit")
    require_free(names, rows, "pivot")

    # One cell per rows and key; then the few cells of each row are set side by side.
    key, cell = free_name("__key", df.columns), free_name("__cell", df.columns)
    keyed = df.withColumn(key, ref(keys).cast("string"))
    cells = aggregate(keyed, {cell: "count" if fn == "count" else (fn, values)}, [*rows, key])
    spread_out = [F.any_value(F.when(F.col(key) == n, F.col(cell)), True).alias(n) for n in names]
    grouped = cells.groupBy(*[ref(r) for r in rows])
    return grouped.agg(*spread_out) if names else cells.select(*[ref(r) for r in rows]).distinct()


SPLIT_MODES = ("spread", "firstN", "lastN", "left", "right")


def split(
    df: DataFrame,
    column: str,
    delimiter: str,
    mode: str = "spread",
    max_columns: int | None = None,
    regex: bool = False,
    keep_original: bool = False,
) -> DataFrame:
    """Pieces of a text column as ``<column>_1``, ``<column>_2``, ….

    ``spread`` is as wide as the longest row; ``firstN`` and ``lastN`` keep at
    most ``max_columns`` pieces, ``lastN`` aligned at the right; ``left`` and
    ``right`` keep one. Short rows are null.
    """
    require_batch(df, "split")
    if mode not in SPLIT_MODES:
        raise ValueError(f"mode must be one of {SPLIT_MODES}")
    require_columns(df, [column])
    cap = 1 if mode in ("left", "right") else (max_columns if mode in ("firstN", "lastN") else None)
    pieces = F.split(ref(column).cast("string"), delimiter if regex else quote_regex(delimiter), -1)
    if mode in ("left", "right"):
        width = 1
    else:
        width = max(df.agg(F.max(F.size(pieces))).first()[0] or 0, 0)
        width = min(width, cap) if cap else width
    names = [f"{column}_{i + 1}" for i in range(width)]
    require_free(names, [c for c in df.columns if c != column], "split")
    held = free_name("__pieces", df.columns)
    from_right = mode in ("lastN", "right")
    base = df.withColumn(held, pieces)
    cells = []
    for i, name in enumerate(names):
        at = F.size(held) - width + i if from_right else F.lit(i)
        cells.append(F.when(at >= 0, F.get(F.col(held), at)).alias(name))
    kept = [ref(c) for c in df.columns if keep_original or c != column]
    return base.select(*kept, *cells)


def _as_array(df: DataFrame, column: str) -> Column:
    """An array column as is, JSON array text parsed; other text is one element."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        return ref(column)
    if isinstance(kind, T.StringType):
        c = ref(column)
        parsed = F.from_json(F.when(c.rlike(r"^\s*\["), c), T.ArrayType(T.StringType()))
        return F.coalesce(parsed, F.when(c.isNotNull(), F.array(c)))
    return F.when(ref(column).isNotNull(), F.array(ref(column)))


def spread(df: DataFrame, column: str, limit: int | None = None, keep_original: bool = False) -> DataFrame:
    """Array elements as columns ``<column>_1``, …, at most ``limit``."""
    require_batch(df, "spread")
    require_columns(df, [column])
    cells = _as_array(df, column)
    width = max(df.agg(F.max(F.size(cells))).first()[0] or 0, 0)
    width = min(width, limit) if limit else width
    names = [f"{column}_{i + 1}" for i in range(width)]
    require_free(names, [c for c in df.columns if keep_original or c != column], "spread")
    kept = [ref(c) for c in df.columns if keep_original or c != column]
    return df.select(*kept, *[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def unroll(df: DataFrame, column: str, indices: bool = False, keep_original: bool = False) -> DataFrame:
    """One row per array element; rows with an empty or missing array vanish.

    ``indices`` adds the 0-based ``<column>__unroll_index``. With
    ``keep_original`` the array stays and the element goes to ``<column>_item``.
    """
    require_columns(df, [column])
    item = f"{column}_item" if keep_original else column
    index = f"{column}__unroll_index"
    new = [*([item] if keep_original else []), *([index] if indices else [])]
    require_free(new, df.columns, "unroll")
    cells = _as_array(df, column)
    if indices:
        made = df.select("*", F.posexplode(cells).alias(index, "__item"))
    else:
        made = df.select("*", F.explode(cells).alias("__item"))
    if keep_original:
        order = [*[ref(c) for c in df.columns], F.col("__item").alias(item)]
    else:
        order = [F.col("__item").alias(c) if c == column else ref(c) for c in df.columns]
    return made.select(*order, *([ref(index)] if indices else []))

