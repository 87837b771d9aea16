"""Appending tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.names import ref, require_columns
from .types import CONVERTERS, LOGICAL_TYPES, physical_type, promote


def _aligned(left: DataFrame, right: DataFrame, columns, target_columns) -> tuple[DataFrame, DataFrame]:
    """Both tables with the left table's columns and a type that holds both."""
    require_columns(left, columns)
    require_columns(right, target_columns)
    kept = [f for f in left.schema.fields if not columns or f.name in columns]
    offered = set(target_columns or right.columns)
    lcols: list[Column] = []
    rcols: list[Column] = []
    for f in kept:
        lc = ref(f.name)
        rc = ref(f.name) if f.name in offered else F.lit(None).cast(f.dataType)
        if f.name in offered and right.schema[f.name].dataType != f.dataType:
            a, b = physical_type(f.dataType), physical_type(right.schema[f.name].dataType)
            both = promote(a, b)
            lc = CONVERTERS[both](lc, a).cast(LOGICAL_TYPES[both])
            rc = CONVERTERS[both](rc, b).cast(LOGICAL_TYPES[both])
        lcols.append(lc.alias(f.name))
        rcols.append(rc.alias(f.name))
    return left.select(*lcols), right.select(*rcols)


def concat(left, right, columns: Sequence[str] = (), target_columns: Sequence[str] = ()) -> DataFrame:
    """All rows of both, in the left table's columns.

    Columns are matched by name; those the right table lacks are null, its extra
    ones are dropped. ``columns`` narrows the left table, ``target_columns`` the right.
    """
    a, b = _aligned(left, right, columns, target_columns)
    return a.unionByName(b)


def union(left, right, columns: Sequence[str] = (), target_columns: Sequence[str] = ()) -> DataFrame:
    """`concat` without repeated rows."""
    return concat(left, right, columns, target_columns).dropDuplicates()
