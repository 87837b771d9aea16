"""Filters, replacement, order, positions, duplicates and samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.attempt import attempt, attempt_condition, can_fail, regex_groups
from ..functions.base import num, value
from ..functions.logic import ERROR_SUFFIX
from ..plans.layout import RN, SMALL_ROWS, TOP_ROWS, broadcast_if_small, positions, top
from ..plans.names import (
    Order, UniqueOrder, free_name, is_orderable, order_items, range_columns, ref, repair_headers, require_columns, sort_columns, total_order,
)
from ..streaming import require_batch
from .columns import as_column
from .types import physical_type

# Names of the job format.
SLICE_MODES = ("first", "last", "removeFirst", "removeLast")


# Filters --------------------------------------------------------------------


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows where the condition is true; null and failing rows are dropped.

    Of a condition joined by ANDs the parts that can't fail are left to the scan.
    """
    return df.filter(attempt_condition(df, as_column(condition)))


def value_condition(df: DataFrame, column: str, op: str, target=None) -> Column:
    """A comparison, or ``is_null``, ``not_null``, ``is_error``, ``not_error``."""
    c = ref(column)
    if op in ("==", "!="):
        if target is None:
            return c.isNull() if op == "==" else c.isNotNull()
        return _same(df, column, target) if op == "==" else _unequal(df, column, target)
    if op in (">", ">=", "<", "<="):
        c, t = _comparable(df, column, target)
        return {">": c > t, ">=": c >= t, "<": c < t, "<=": c <= t}[op]
    if op in ("is_null", "not_null"):
        return c.isNull() if op == "is_null" else c.isNotNull()
    if op in ("is_error", "not_error"):
        name = column + ERROR_SUFFIX
        failed = ref(name).isNotNull() if name in df.columns else F.lit(False)
        return failed if op == "is_error" else ~failed
    raise ValueError(f"unknown comparison: {op}")


def _unlike(df: DataFrame, column: str, x) -> bool:
    """A Python value of another kind than the column: text beside numbers, for example."""
    if isinstance(x, Column) or x is None:
        return False
    kinds = {bool: {"boolean"}, int: {"integer", "float"}, float: {"integer", "float"}, str: {"string", "date", "datetime"}}
    return physical_type(df.schema[column].dataType) not in kinds.get(type(x), {"date", "datetime", "string", "json"})


def _same(df: DataFrame, column: str, target) -> Column:
    """Values of unlike kinds never match; text that isn't a date doesn't match a date."""
    if _unlike(df, column, target):
        return F.lit(False)
    plain = ref(column) == value(target)
    return F.coalesce(attempt(df, plain), F.lit(False)) if can_fail(df, plain) else plain


def _unequal(df: DataFrame, column: str, target) -> Column:
    """Null is unequal to every value."""
    if _unlike(df, column, target):
        return F.lit(True)
    plain = ref(column).eqNullSafe(value(target))
    return ~(F.coalesce(attempt(df, plain), F.lit(False)) if can_fail(df, plain) else plain)


def _comparable(df: DataFrame, column: str, target) -> tuple[Column, Column]:
    """Column and value for an order comparison: as numbers if they are unlike, null where that fails."""
    if not _unlike(df, column, target):
        return ref(column), attempt(df, value(target).cast(df.schema[column].dataType)) if isinstance(target, str) else value(target)
    return num(ref(column)), num(value(target))


def _beside(df: DataFrame, column: str, new) -> tuple[Column, Column]:
    """Column and replacement in one type: text if they are unlike."""
    if _unlike(df, column, new):
        return ref(column).cast("string"), value(new).cast("string")
    return ref(column), value(new)


def filter_value(df: DataFrame, column: str, op: str, target=None) -> DataFrame:
    require_columns(df, [column])
    return df.filter(value_condition(df, column, op, target))


def filter_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Both ends included."""
    require_columns(df, [column])
    c, least = _comparable(df, column, low)
    d, most = _comparable(df, column, high)
    return df.filter((c >= least) & (d <= most))


# Replacement ----------------------------------------------------------------


def replace_value(df: DataFrame, column: str, find, replacement) -> DataFrame:
    """Exact equality, where null equals null."""
    found = ref(column).isNull() if find is None else _same(df, column, find)
    c, new = _beside(df, column, replacement)
    return df.withColumn(column, F.when(found, new).otherwise(c))


def replace_regex(df: DataFrame, column: str, pattern: str, replacement: str = "") -> DataFrame:
    """All matches; the column becomes text. An invalid pattern leaves the values."""
    if regex_groups(pattern) is None:
        return df.withColumn(column, ref(column).cast("string"))
    return df.withColumn(column, F.regexp_replace(ref(column).cast("string"), pattern, replacement))


def replace_nulls(df: DataFrame, column: str, replacement) -> DataFrame:
    """Missing cells, but not failed ones."""
    error = column + ERROR_SUFFIX
    missing = ref(column).isNull()
    if error in df.columns:
        missing = missing & ref(error).isNull()
    c, new = _beside(df, column, replacement)
    return df.withColumn(column, F.when(missing, new).otherwise(c))


def replace_errors(df: DataFrame, column: str, replacement) -> DataFrame:
    """Failed cells; the error message is cleared."""
    error = column + ERROR_SUFFIX
    if error not in df.columns:
        return df
    c, new = _beside(df, column, replacement)
    fixed = F.when(ref(error).isNotNull(), new).otherwise(c)
    return df.withColumn(column, fixed).withColumn(error, F.lit(None).cast("string"))


# Order and position ---------------------------------------------------------


def sort(df: DataFrame, by: Order, break_ties: bool = True) -> DataFrame:
    """Ascending nulls first, descending nulls last.

    Ties are broken by the other columns: the result is then the same for any
    partitioning, and one frequent sort value still spreads over many tasks. The
    partitions' bounds are short keys, whole texts are compared only inside a partition.
    """
    require_batch(df, "sort")
    items = total_order(df, by) if break_ties else order_items(by)
    require_columns(df, [n for n, _ in items])
    long = (T.StringType, T.BinaryType, T.ArrayType, T.StructType)
    keys = range_columns(df, items)
    if not keys or not any(isinstance(df.schema[n].dataType, long) for n, _ in items):
        return df.orderBy(*sort_columns(items))
    return df.repartitionByRange(*keys).sortWithinPartitions(*sort_columns(items))


def slice_rows(df: DataFrame, count: int, mode: str, order_by: Order) -> DataFrame:
    """First or last rows of an order, or all but those."""
    require_batch(df, "slice_rows")
    count = max(int(count), 0)
    if mode in ("first", "last"):
        return top(df, order_by, count, reverse=mode == "last")
    if mode not in SLICE_MODES:
        raise ValueError(f"mode must be one of {SLICE_MODES}")
    if count == 0:
        return df
    return _without(df, order_by, count, reverse=mode == "removeLast")


def _without(df: DataFrame, order_by: Order, count: int, reverse: bool) -> DataFrame:
    """All rows but the first ``count`` of the (reversed) order.

    For a small count the row that ends the cut is found by a top-n, and the rest
    is a filter with that row's values: no sort of the table. Rows tied with the
    cut need real positions.
    """
    items = [(n, d != reverse) for n, d in total_order(df, order_by)]
    atomic = not any(isinstance(df.schema[n].dataType, (T.ArrayType, T.StructType)) for n, _ in items)
    total = isinstance(order_by, UniqueOrder) or len(items) == len(df.columns)
    if count < TOP_ROWS and atomic and total:
        head = df.orderBy(*sort_columns(items)).limit(count + 1)
        back = [(n, not d) for n, d in items]
        edge = head.orderBy(*sort_columns(back)).limit(2).select(*[ref(n) for n, _ in items]).collect()
        if len(edge) == 2 and not _equal_rows(*edge) and head.count() == count + 1:
            return df.filter(_after(df, items, edge[1]))
    numbered = positions(df, order_by)
    keep = F.col(RN) <= df.count() - count if reverse else F.col(RN) > count
    return numbered.filter(keep).drop(RN)


def _equal_rows(a, b) -> bool:
    """As Spark compares: NaN equals NaN."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _after(df: DataFrame, items: Sequence[tuple[str, bool]], row) -> Column:
    """Rows strictly behind ``row`` in the order, compared column by column."""
    result = F.lit(False)
    for name, descending in reversed(list(items)):
        c, kind = ref(name), df.schema[name].dataType
        zone_free = isinstance(kind, T.TimestampNTZType) and row[name] is not None
        edge = F.lit(row[name].isoformat() if zone_free else row[name]).cast(kind)
        if row[name] is None:
            beyond = F.lit(False) if descending else c.isNotNull()
        elif descending:
            beyond = F.coalesce(c < edge, F.lit(True))
        else:
            beyond = F.coalesce(c > edge, F.lit(False))
        result = beyond | (c.eqNullSafe(edge) & result)
    return result


GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_k(df: DataFrame, by: Order, k: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """The first k rows, or the first k of each group.

    Per group Spark prunes with a rank limit before the shuffle, so a frequent
    key sends at most k rows per task. Beyond the k up to which it does so, groups
    above the hot limit are numbered by range partitions.
    """
    require_batch(df, "top_k")
    if not partition_by:
        return top(df, by, k)
    if k > int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000")):
        from .window import window

        place = free_name("__place", df.columns)
        return window(df, {place: "row_number"}, by, partition_by).filter(F.col(place) <= k).drop(place)
    from pyspark.sql import Window

    w = Window.partitionBy(*[ref(p) for p in partition_by]).orderBy(*sort_columns(total_order(df, by)))
    return df.withColumn(RN, F.row_number().over(w)).filter(F.col(RN) <= k).drop(RN)


def add_index(df: DataFrame, name: str, order_by: Order, start: int = 1) -> DataFrame:
    """Consecutive numbers in the given order."""
    require_batch(df, "add_index")
    source = df.drop(name) if name in df.columns else df
    out = positions(source, order_by, "__index").withColumn(name, F.col("__index") + F.lit(start - 1)).drop("__index")
    return out


def _by_positions(df: DataFrame, indices: Sequence[int], order_by: Order, keep: bool) -> DataFrame:
    wanted = sorted({int(i) + 1 for i in indices if int(i) >= 0})
    if not wanted:
        return df.limit(0) if keep else df
    small = keep and wanted[-1] <= TOP_ROWS
    numbered = positions_of_top(df, order_by, wanted[-1]) if small else positions(df, order_by)
    if len(wanted) <= 1000:
        hit = F.col(RN).isin(wanted)
        return numbered.filter(hit if keep else ~hit).drop(RN)
    marks = df.sparkSession.createDataFrame([(i,) for i in wanted], "pos long")
    marks = F.broadcast(marks) if len(wanted) <= SMALL_ROWS else marks
    return numbered.join(marks, F.col(RN) == F.col("pos"), "left_semi" if keep else "left_anti").drop(RN)


def positions_of_top(df: DataFrame, order_by: Order, n: int) -> DataFrame:
    """Positions of the first n rows only."""
    from pyspark.sql import Window

    w = Window.orderBy(*sort_columns(total_order(df, order_by)))
    return top(df, order_by, n).withColumn(RN, F.row_number().over(w))


def keep_rows(df: DataFrame, indices: Sequence[int], order_by: Order) -> DataFrame:
    """Rows at 0-based positions."""
    require_batch(df, "keep_rows")
    return _by_positions(df, indices, order_by, keep=True)


def remove_rows(df: DataFrame, indices: Sequence[int], order_by: Order) -> DataFrame:
    """All rows but those at 0-based positions."""
    require_batch(df, "remove_rows")
    return _by_positions(df, indices, order_by, keep=False)


def promote_header(df: DataFrame, order_by: Order, skip: int = 0) -> DataFrame:
    """The row at position ``skip`` names the columns; it and the rows before it go.

    The order column takes part like any other and is renamed with it.
    """
    require_batch(df, "promote_header")
    head = keep_rows(df, [skip], order_by).select(*[ref(c).cast("string").alias(c) for c in df.columns]).first()
    if head is None:
        raise ValueError(f"the table has no row {skip} to take names from")
    return slice_rows(df, skip + 1, "removeFirst", order_by).toDF(*repair_headers(list(head)))


# Duplicates -----------------------------------------------------------------


def dedupe(df: DataFrame, columns: Sequence[str] = (), order_by: Order | None = None, mode: str = "remove") -> DataFrame:
    """``remove``: the first row of each key; ``keep``: all rows whose key repeats.

    Both are aggregates with map-side combine. Nulls equal each other.
    """
    require_columns(df, columns)
    keys = list(columns) or df.columns
    if mode == "keep":
        require_batch(df, "dedupe keep")
        repeated = df.groupBy(*[ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
        repeated = repeated.select(*[ref(k).alias(f"__k{i}") for i, k in enumerate(keys)])
        same = reduce(lambda a, b: a & b, [ref(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        return df.join(repeated, same, "left_semi")
    if mode != "remove":
        raise ValueError("mode must be remove or keep")
    if not columns or set(keys) == set(df.columns):
        return df.dropDuplicates()
    require_batch(df, "dedupe by key")
    if order_by is None:
        raise ValueError("keeping the first row of a key needs order_by")
    rest = [c for c in df.columns if c not in keys]
    items = [(n, d) for n, d in total_order(df, order_by) if n not in keys]
    if any(d for _, d in items):
        from pyspark.sql import Window

        w = Window.partitionBy(*[ref(k) for k in keys]).orderBy(*sort_columns(total_order(df, order_by)))
        return df.withColumn(RN, F.row_number().over(w)).filter(F.col(RN) == 1).drop(RN)
    first = F.min_by(F.struct(*[ref(c) for c in rest]), F.struct(*[ref(n).alias(f"o{i}") for i, (n, _) in enumerate(items)]))
    found = df.groupBy(*[ref(k) for k in keys]).agg(first.alias("__first"))
    return found.select(*[ref(c) if c in keys else F.col("__first").getField(c).alias(c) for c in df.columns])


# Samples --------------------------------------------------------------------

COPIES = 1 << 16  # copies of one row that a single task numbers


def sample(df: DataFrame, count: int, seed: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``count`` rows without replacement.

    With a seed the rows are those with the smallest hash of seed, row and number among its copies: the same
    rows under any partitioning, and copies are drawn independently. ``keys`` spare that count of copies: only
    they are hashed, so they should tell all rows apart; rows that share them are drawn together.
    """
    require_batch(df, "sample")
    count = max(int(count), 0)
    if seed is not None and not keys:
        return _sample_with_copies(df, count, int(seed))
    require_columns(df, keys)
    mark = F.rand() if seed is None else F.xxhash64(F.lit(int(seed)), *[ref(n) for n in keys])
    marked = df.select(*[ref(c) for c in df.columns], mark.alias("__mark"))
    return top(marked, UniqueOrder(["__mark"]) if seed is None else ["__mark", *keys], count).drop("__mark")


def _sample_with_copies(df: DataFrame, count: int, seed: int) -> DataFrame:
    """Counts equal rows by a 128-bit hash, marks every copy, and takes as many copies of each row as are drawn.

    Only hashes are shuffled for that. Copies are numbered in blocks, so a row with very many is shared among tasks.
    """
    cells = [ref(f.name) if is_orderable(f.dataType) else F.to_json(F.struct(ref(f.name))) for f in df.schema.fields]
    one, two = F.xxhash64(F.lit(seed), *cells), F.xxhash64(*cells, F.lit(seed))
    counts = df.groupBy(one.alias("__one"), two.alias("__two")).agg(F.count(F.lit(1)).alias("__n"))
    blocks = counts.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES))))
    blocks = counts.filter(F.col("__n") <= COPIES).withColumn("__block", F.lit(0).cast("long")).unionByName(
        blocks.filter(F.col("__n") > COPIES).repartition("__one", "__block")
    )
    first = F.col("__block") * COPIES
    last = F.least(first + COPIES, F.col("__n")) - 1
    copies = blocks.select("__one", "__two", F.explode(F.sequence(first, last)).alias("__copy"))
    marked = copies.select(F.xxhash64("__one", "__two", "__copy").alias("__mark"), "__one", "__two", "__copy")
    drawn = top(marked, UniqueOrder(["__mark", "__one", "__two", "__copy"]), count)
    taken = broadcast_if_small(drawn.groupBy("__one", "__two").agg(F.count(F.lit(1)).cast("int").alias("__times")))
    taken = taken.withColumnsRenamed({"__one": "__key", "__two": "__key2"})
    found = df.select(F.struct(*[ref(c) for c in df.columns]).alias("__row"), one.alias("__one"), two.alias("__two"))
    found = found.join(taken, (F.col("__one") == F.col("__key")) & (F.col("__two") == F.col("__key2")))
    rows = found.groupBy("__one", "__two", "__times").agg(F.any_value("__row").alias("__row"))
    rows = rows.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])
