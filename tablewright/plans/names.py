"""Column naming: clashes, free names, order lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Order = "Sequence[str | tuple[str, str]] | str"


class UniqueOrder(list):
    """An order no two rows tie in, such as one ending in a key.

    ``order_by=UniqueOrder(["ts", "event_id"])`` spares the tie-breaks, and with
    them the columns that only tie-breaks would read.
    """


def ref(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; the table has {df.columns}")


def require_free(new: Iterable[str], existing: Iterable[str], operation: str) -> None:
    """Generated names never overwrite a column that stays."""
    new, taken = list(new), set(existing)
    clashes = sorted({n for n in new if n in taken or new.count(n) > 1})
    if clashes:
        raise ValueError(f"{operation} would overwrite columns: {', '.join(clashes)}")


def free_name(wanted: str, existing: Iterable[str]) -> str:
    taken, name, i = set(existing), wanted, 2
    while name in taken:
        name, i = f"{wanted}_{i}", i + 1
    return name


def repair_headers(headers: Sequence[str | None], blank: str = "Column {}") -> list[str]:
    """Blank headers get a numbered name, repeated ones ``_2``, ``_3``."""
    out: list[str] = []
    for i, raw in enumerate(headers, 1):
        name = "" if raw is None else str(raw).strip()
        out.append(free_name(name or blank.format(i), out))
    return out


def order_items(order_by: Order) -> list[tuple[str, bool]]:
    """``[(column, descending)]`` from names and ``(name, "asc"|"desc")`` pairs."""
    items = [order_by] if isinstance(order_by, str) else list(order_by)
    out = []
    for item in items:
        name, way = (item, "asc") if isinstance(item, str) else item
        if way not in ("asc", "desc"):
            raise ValueError(f"order must be asc or desc, not {way}")
        out.append((name, way == "desc"))
    if not out:
        raise ValueError("order_by must name at least one column")
    return out


def sort_columns(items: Sequence[tuple[str, bool]], reverse: bool = False) -> list[Column]:
    """Ascending puts nulls first, descending last; ``reverse`` mirrors both."""
    return [ref(n).desc_nulls_last() if d != reverse else ref(n).asc_nulls_first() for n, d in items]


KEY_CHARS = 32  # leading characters of a text that a range key holds


def range_columns(df: DataFrame, items: Sequence[tuple[str, bool]]) -> list[Column]:
    """Short keys that partition by range as the whole order does.

    Range bounds are sampled to the driver and compared for every row, so a text gives its
    first characters and whether there are more, and nested values nothing. Later columns
    follow only where all texts before them are whole. Rows with equal keys share a partition,
    and the sort inside it compares whole columns.
    """
    out, whole = [], None
    for name, descending in items:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.ArrayType, T.StructType, T.BinaryType)):
            break
        c = ref(name)
        keys = [F.substring(c, 1, KEY_CHARS), F.char_length(c) > KEY_CHARS] if isinstance(kind, T.StringType) else [c]
        keys = keys if whole is None else [F.when(whole, k) for k in keys]
        out += [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]
        if isinstance(kind, T.StringType):
            short = F.coalesce(F.char_length(c) <= KEY_CHARS, F.lit(True))
            whole = short if whole is None else whole & short
    return out


def is_orderable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return is_orderable(t.elementType)
    if isinstance(t, T.StructType):
        return all(is_orderable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType, T.NullType))


def total_order(df: DataFrame, order_by: Order, first: Sequence[str] = (), among: Sequence[str] | None = None) -> list[tuple[str, bool]]:
    """The given order, then the other orderable columns as tie-breaks.

    With that, rows that still tie are identical, so a result that depends on
    position is the same for any partitioning. ``first`` are leading keys;
    ``among`` narrows the tie-breaks to the columns a result shows.
    """
    items = [(n, False) for n in first] + order_items(order_by)
    require_columns(df, [n for n, _ in items])
    if isinstance(order_by, UniqueOrder):
        return items
    used = {n for n, _ in items}
    ties = [f for f in df.schema.fields if f.name not in used and (among is None or f.name in among)]
    return items + [(f.name, False) for f in ties if is_orderable(f.dataType)]
