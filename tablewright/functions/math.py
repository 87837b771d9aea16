"""Math functions. Input is read as a number; what is not a number gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import nan_to_null, num

_EXACT = float(2**53)  # beyond this a double has no fraction


def _num(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else num(x)


def _whole(rounder, x: Column) -> Column:
    return F.when(F.abs(x) < _EXACT, rounder(x).cast("double")).otherwise(x)


def abs_(x) -> Column:
    return F.abs(_num(x))


def pow_(x, y) -> Column:
    return nan_to_null(F.pow(_num(x), _num(y)))


def sqrt(x) -> Column:
    x = _num(x)
    return F.when(x >= 0, F.sqrt(x))


def cbrt(x) -> Column:
    return F.cbrt(_num(x))


def exp(x) -> Column:
    return F.exp(_num(x))


def _positive(fn, x) -> Column:
    x = _num(x)
    return F.when(x > 0, fn(x))


def ln(x) -> Column:
    return _positive(F.ln, x)


def log10(x) -> Column:
    return _positive(F.log10, x)


def log2(x) -> Column:
    return _positive(F.log2, x)


def sin(x) -> Column:
    return F.sin(_num(x))


def cos(x) -> Column:
    return F.cos(_num(x))


def tan(x) -> Column:
    return F.tan(_num(x))


def atan(x) -> Column:
    return F.atan(_num(x))


def atan2(y, x) -> Column:
    return F.atan2(_num(y), _num(x))


def _unit_interval(fn, x) -> Column:
    x = _num(x)
    return F.when(x.between(-1.0, 1.0), fn(x))


def asin(x) -> Column:
    return _unit_interval(F.asin, x)


def acos(x) -> Column:
    return _unit_interval(F.acos, x)


def radians(x) -> Column:
    return F.radians(_num(x))


def degrees(x) -> Column:
    return F.degrees(_num(x))


def sign(x) -> Column:
    return F.signum(_num(x))


def floor(x) -> Column:
    return _whole(F.floor, _num(x))


def ceil(x) -> Column:
    return _whole(F.ceil, _num(x))


def trunc(x) -> Column:
    """Toward zero."""
    x = _num(x)
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def round_(x, digits: int = 0) -> Column:
    """Half rounds toward plus infinity: 2.5 gives 3, -2.5 gives -2."""
    scale = float(10**digits)
    x = _num(x)
    scaled = x * F.lit(scale)
    return F.when(F.abs(scaled) < _EXACT, F.floor(scaled + F.lit(0.5)).cast("double") / F.lit(scale)).otherwise(x)


def pi() -> Column:
    return F.pi()


def e() -> Column:
    return F.e()


def min_(*xs) -> Column:
    """Row-wise smallest number; nulls are skipped."""
    return _num(xs[0]) if len(xs) == 1 else F.least(*[_num(x) for x in xs])


def max_(*xs) -> Column:
    """Row-wise largest number; nulls are skipped."""
    return _num(xs[0]) if len(xs) == 1 else F.greatest(*[_num(x) for x in xs])


# Operators. ``+``, ``-``, ``*`` and the orderings are Spark's own.


def divide(x, y) -> Column:
    """Null on division by zero (no infinities enter a table)."""
    return F.try_divide(_num(x), _num(y))


def mod(x, y) -> Column:
    """Remainder with the dividend's sign; null when the divisor is zero."""
    return F.try_mod(_num(x), _num(y))
