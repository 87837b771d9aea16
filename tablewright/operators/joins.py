"""Equality joins, lookups, and a report on join keys.

No side is ever forced to be broadcast: Spark broadcasts below its own size
threshold and otherwise sorts and merges, splitting skewed partitions at run
time. A full join is a left join plus the unmatched right rows, because Spark
splits skewed partitions for those two but not for a full outer join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import round_
from ..plans.names import Order, order_items, ref, require_columns, require_free, total_order
from ..streaming import require_batch
from .types import physical_type

HOW = ("inner", "left", "right", "full", "cross")
On = "str | Sequence[str | tuple[str, str]]"


def key_pairs(on: On) -> list[tuple[str, str]]:
    """``"id"``, ``["id", "day"]`` or ``[("id", "user_id")]``."""
    items = [on] if isinstance(on, str) else list(on)
    return [(i, i) if isinstance(i, str) else (i[0], i[1]) for i in items]


def _prepared(left: DataFrame, right: DataFrame, pairs, suffixes) -> tuple[DataFrame, DataFrame, dict]:
    """Both sides with clashing columns suffixed; keys of the same name stay shared."""
    shared = {a for a, b in pairs if a == b}
    clash = [c for c in left.columns if c in right.columns and c not in shared]
    lnames = {c: c + suffixes[0] for c in clash}
    rnames = {c: c + suffixes[1] for c in clash}
    left_names = [lnames.get(c, c) for c in left.columns]
    right_names = [rnames.get(c, c) for c in right.columns]
    require_free(right_names, [n for n in left_names if n not in shared], "join")
    return left.withColumnsRenamed(lnames), right.withColumnsRenamed(rnames), {"left": lnames, "right": rnames}


def _unlike(left: DataFrame, right: DataFrame, pairs) -> set:
    """Keys of which one side only is text."""
    is_text = lambda df, c: physical_type(df.schema[c].dataType) == "string"
    return {(a, b) for a, b in pairs if is_text(left, a) != is_text(right, b)}


def _equal(a: Column, b: Column, as_text: bool) -> Column:
    return a.cast("string") == b.cast("string") if as_text else a == b


def _condition(pairs, left_of, right_of, unlike=frozenset()) -> Column:
    """Equal keys; unlike ones are compared as text, so that ``x`` doesn't match a number instead of failing."""
    return reduce(lambda a, b: a & b, [_equal(left_of(a), right_of(b), (a, b) in unlike) for a, b in pairs])


def join(
    left: DataFrame,
    right: DataFrame,
    on: On = (),
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Null keys never match. Keys of the same name become one column."""
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    if not right.columns:
        return left if how in ("left", "full") else left.limit(0)
    pairs = [] if how == "cross" else key_pairs(on)
    if how != "cross" and not pairs:
        raise ValueError("join needs at least one key")
    require_columns(left, [a for a, _ in pairs])
    require_columns(right, [b for _, b in pairs])
    l, r, names = _prepared(left, right, pairs, suffixes)
    if how == "cross":
        return l.crossJoin(r)

    # Right columns get private names for the join, so no reference is ambiguous.
    private = {c: f"__r{i}" for i, c in enumerate(r.columns)}
    r = r.withColumnsRenamed(private)
    shared = {a for a, b in pairs if a == b}
    cond = _condition(
        pairs, lambda a: ref(names["left"].get(a, a)), lambda b: ref(private[names["right"].get(b, b)]), _unlike(left, right, pairs),
    )
    outputs = [ref(c) for c in l.columns] + [ref(p).alias(c) for c, p in private.items() if c not in shared]
    if how in ("inner", "left"):
        return l.join(r, cond, how).select(*outputs)
    if how == "right":
        filled = [ref(private[c]).alias(c) if c in shared else ref(c) for c in l.columns]
        return l.join(r, cond, "right").select(*filled, *outputs[len(filled):])

    matched = l.join(r, cond, "left").select(*outputs)
    left_keys = l.select(*[ref(names["left"].get(a, a)).alias(f"__k{i}") for i, (a, _) in enumerate(pairs)]).distinct()
    unmatched = reduce(
        lambda x, y: x & y,
        [F.col(f"__k{i}") == ref(private[names["right"].get(b, b)]) for i, (_, b) in enumerate(pairs)],
    )
    alone = r.join(left_keys, unmatched, "left_anti")
    fill = [
        ref(private[c]).alias(c) if c in shared else F.lit(None).cast(l.schema[c].dataType).alias(c) for c in l.columns
    ]
    rest = [ref(p).alias(c) for c, p in private.items() if c not in shared]
    return matched.unionByName(alone.select(*fill, *rest))


def _filtering(left: DataFrame, right: DataFrame, on: On, how: str) -> DataFrame:
    if not right.columns:
        return left.limit(0) if how == "left_semi" else left
    pairs = key_pairs(on)
    require_columns(left, [a for a, _ in pairs])
    require_columns(right, [b for _, b in pairs])
    # Only the distinct keys of the right side travel.
    keys = right.select(*[ref(b).alias(f"__k{i}") for i, (_, b) in enumerate(pairs)]).distinct()
    unlike = _unlike(left, right, pairs)
    cond = reduce(lambda x, y: x & y, [_equal(ref(a), F.col(f"__k{i}"), (a, b) in unlike) for i, (a, b) in enumerate(pairs)])
    return left.join(keys, cond, how)


def semijoin(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    """Left rows with a match, never repeated."""
    return _filtering(left, right, on, "left_semi")


def antijoin(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    """Left rows without a match; null keys stay."""
    return _filtering(left, right, on, "left_anti")


def lookup(
    left: DataFrame, right: DataFrame, on: On, values: Sequence[str], order_by: Order | None = None
) -> DataFrame:
    """Adds ``values`` of the last matching right row; left rows are never repeated.

    The right side shrinks to one row per key by a map-side combined aggregate
    before it is joined.
    """
    values = list(values)
    if not right.columns:
        return left.select("*", *[F.lit(None).cast("string").alias(v) for v in values])
    require_batch(right, "lookup")
    pairs = key_pairs(on)
    require_columns(left, [a for a, _ in pairs])
    require_columns(right, [*[b for _, b in pairs], *values])
    require_free(values, left.columns, "lookup")
    if order_by is None:
        raise ValueError("lookup takes the last of several matches: pass order_by for the right table")
    if any(d for _, d in order_items(order_by)):
        raise ValueError("lookup takes an ascending order_by")
    order = F.struct(*[ref(n).alias(f"o{i}") for i, (n, _) in enumerate(total_order(right, order_by, among=values))])
    keyed = right.groupBy(*[ref(b).alias(f"__k{i}") for i, (_, b) in enumerate(pairs)])
    last = keyed.agg(F.max_by(F.struct(*[ref(v) for v in values]), order).alias("__last"))
    unlike = _unlike(left, right, pairs)
    cond = reduce(lambda x, y: x & y, [_equal(ref(a), F.col(f"__k{i}"), (a, b) in unlike) for i, (a, b) in enumerate(pairs)])
    return left.join(last, cond, "left").select(
        *[ref(c) for c in left.columns], *[F.col("__last").getField(v).alias(v) for v in values]
    )


def join_key_report(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    """One row per key pair: distinct values, duplicates, nulls, matches and coverage.

    Each side is first reduced to a count per value, so a frequent value is one row.
    """
    reports = []
    for a, b in key_pairs(on):
        require_columns(left, [a])
        require_columns(right, [b])
        lc = left.groupBy(ref(a).alias("__a")).agg(F.count(F.lit(1)).alias("__n"))
        rc = right.groupBy(ref(b).alias("__b")).agg(F.count(F.lit(1)).alias("__m"))
        both = lc.join(rc, F.col("__a") == F.col("__b"), "full")
        n, m = F.coalesce(F.col("__n"), F.lit(0)), F.coalesce(F.col("__m"), F.lit(0))
        on_left, on_right = F.col("__a").isNotNull(), F.col("__b").isNotNull()
        matched = on_left & on_right
        sums = both.agg(
            F.count_if(on_left).alias("left_unique"),
            F.count_if(on_right).alias("right_unique"),
            F.count_if(matched).alias("matches"),
            F.count_if(on_left & ~on_right).alias("left_only"),
            F.count_if(on_right & ~on_left).alias("right_only"),
            F.coalesce(F.sum(n), F.lit(0)).alias("left_rows"),
            F.coalesce(F.sum(m), F.lit(0)).alias("right_rows"),
            F.coalesce(F.sum(F.when(on_left, n)), F.lit(0)).alias("left_non_null"),
            F.coalesce(F.sum(F.when(on_right, m)), F.lit(0)).alias("right_non_null"),
            F.coalesce(F.sum(F.when(matched, n)), F.lit(0)).alias("left_matched"),
            F.coalesce(F.sum(F.when(matched, m)), F.lit(0)).alias("right_matched"),
        )

        def percent(part: Column, whole: str) -> Column:
            share = F.try_divide(part * F.lit(100.0), F.col(whole))
            return F.coalesce(round_(share), F.lit(0.0)).cast("int")

        reports.append(
            sums.select(
                F.lit(a).alias("left_column"),
                F.lit(b).alias("right_column"),
                "left_unique",
                "right_unique",
                (F.col("left_non_null") > F.col("left_unique")).alias("left_has_duplicates"),
                (F.col("right_non_null") > F.col("right_unique")).alias("right_has_duplicates"),
                "matches",
                "left_only",
                "right_only",
                "left_rows",
                "right_rows",
                (F.col("left_rows") - F.col("left_non_null")).alias("left_nulls"),
                (F.col("right_rows") - F.col("right_non_null")).alias("right_nulls"),
                percent(F.col("left_matched"), "left_non_null").alias("left_match_percent"),
                percent(F.col("right_matched"), "right_non_null").alias("right_match_percent"),
                percent(F.col("left_non_null") - F.col("left_matched"), "left_non_null").alias("left_only_percent"),
                percent(F.col("right_non_null") - F.col("right_matched"), "right_non_null").alias("right_only_percent"),
            )
        )
    return reduce(DataFrame.unionByName, reports)


def unmatched_values(left: DataFrame, right: DataFrame, on: str | tuple[str, str]) -> DataFrame:
    """Distinct key values found on one side only, as text, with the side."""
    a, b = key_pairs([on])[0]
    lv = left.select(ref(a).alias("v")).filter(F.col("v").isNotNull()).distinct()
    rv = right.select(ref(b).alias("v")).filter(F.col("v").isNotNull()).distinct()
    left_only = lv.join(rv, "v", "left_anti").select(F.lit("left").alias("side"), F.col("v").cast("string").alias("value"))
    right_only = rv.join(lv, "v", "left_anti").select(F.lit("right").alias("side"), F.col("v").cast("string").alias("value"))
    return left_only.union(right_only)
