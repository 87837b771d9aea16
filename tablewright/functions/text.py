"""String functions. Missing input gives null, except the tests, which give false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import WHITE_SPACE, as_text, col, false_if_null, quote_regex, value


def upper(s) -> Column:
    return F.upper(as_text(s))


def lower(s) -> Column:
    return F.lower(as_text(s))


def titlecase(s) -> Column:
    return F.initcap(as_text(s))


def trim(s) -> Column:
    """Strips every kind of white space, not only blanks."""
    return F.trim(as_text(s), F.lit(WHITE_SPACE))


def substring(s, start, length=None) -> Column:
    """0-based; a negative start counts as 0."""
    s = as_text(s)
    first = F.greatest(value(start), F.lit(0)) + F.lit(1)
    size = F.length(s) if length is None else F.greatest(value(length), F.lit(0))
    return F.substr(s, first.cast("int"), size.cast("int"))


def length(s) -> Column:
    """Characters (code points)."""
    return F.length(as_text(s))


def split(s, delimiter: str, index: int = 0) -> Column:
    """Piece number ``index`` (negative counts from the end); out of range is null."""
    pieces = F.split(as_text(s), quote_regex(delimiter), -1) if delimiter else F.split(as_text(s), "", -1)
    return F.try_element_at(pieces, F.lit(index + 1 if index >= 0 else index))


def equals(s, t) -> Column:
    return false_if_null(as_text(s) == value(t).cast("string"))


def contains(s, t) -> Column:
    return false_if_null(F.contains(as_text(s), value(t).cast("string")))


def starts_with(s, t) -> Column:
    return false_if_null(F.startswith(as_text(s), value(t).cast("string")))


def ends_with(s, t) -> Column:
    return false_if_null(F.endswith(as_text(s), value(t).cast("string")))


def _ci(test):
    def apply(s, t) -> Column:
        return test(F.lower(as_text(s)), F.lower(value(t).cast("string")))

    apply.__name__ = test.__name__ + "_ci"
    apply.__doc__ = f"`{test.__name__}` ignoring case."
    return apply


equals_ci = _ci(equals)
contains_ci = _ci(contains)
starts_with_ci = _ci(starts_with)
ends_with_ci = _ci(ends_with)


def concat(*parts) -> Column:
    """``+`` on text: null if any part is null."""
    return F.concat(*[col(p).cast("string") for p in parts])
