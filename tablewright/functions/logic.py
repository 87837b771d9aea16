"""Type tests, choices, and comparisons with the library's null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import as_text, col, false_if_null, num, value

ERROR_SUFFIX = "__error"

# The leading part of a text that is read as a number.
INT_PREFIX = r"^\s*([+-]?\d+)"
FLOAT_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def parse_int(x) -> Column:
    """Leading integer of a text: ``12abc`` gives 12."""
    return F.regexp_extract(as_text(x), INT_PREFIX, 1).try_cast("bigint")


def parse_float(x) -> Column:
    return F.regexp_extract(as_text(x), FLOAT_PREFIX, 1).try_cast("double")


def is_nan(x) -> Column:
    """True where a present value is not a number."""
    x = col(x)
    return x.isNotNull() & num(x).isNull()


def is_error(name: str) -> Column:
    """True where a conversion of column ``name`` failed."""
    return F.col(f"`{name}{ERROR_SUFFIX}`").isNotNull()


def if_(condition, then, otherwise) -> Column:
    return F.when(false_if_null(col(condition)), value(then)).otherwise(value(otherwise))


def coalesce(*xs) -> Column:
    return F.coalesce(*[col(x) for x in xs])


def eq(a, b) -> Column:
    """Null equals null, and nothing else."""
    return col(a).eqNullSafe(b)


def ne(a, b) -> Column:
    return ~col(a).eqNullSafe(b)


def not_(x) -> Column:
    """``not null`` is true."""
    return ~false_if_null(col(x))
