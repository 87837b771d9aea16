"""Shared coercions for the column functions.

Every function here takes column names or Columns and returns a Column, so the
whole library stays inside Catalyst expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space at the ends of text, text accepted as a number, and
# as a date outside ISO form.
WHITE_SPACE = " \t\n\x0b\x0c\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
OFFSET_AT_END = r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|UTC|[+-]\d{2}:?\d{2})\s*$"
EXTRA_DATETIME_FORMATS = (
    "yyyy/M/d",
    "yyyy/M/d H:m:s",
    "M/d/yyyy",
    "M/d/yyyy H:m:s",
    "MMM d, yyyy",
    "MMM d yyyy",
    "d MMM yyyy",
)


def col(x: Column | str) -> Column:
    """A column name becomes a reference; a Column passes through."""
    return F.col(x) if isinstance(x, str) else x


def value(x) -> Column:
    """A Python scalar becomes a literal; a Column passes through."""
    return x if isinstance(x, Column) else F.lit(x)


def is_text(x: Column) -> Column:
    """Constant-folded by the optimizer, so only one branch stays in the plan."""
    return F.typeof(x) == F.lit("string")


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def num(x: Column | str) -> Column:
    """Double, or null where the value is not a number (text such as ``12kg``, NaN)."""
    x = col(x)
    parsed = x.try_cast("double")
    text_ok = x.cast("string").rlike(NUMBER_TEXT)
    return nan_to_null(F.when(~is_text(x) | text_ok, parsed))


def as_text(x: Column | str) -> Column:
    return col(x).cast("string")


def utc(instant: Column) -> Column:
    """The zone-free timestamp an instant has in UTC, whatever the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def iso_ts(text: Column) -> Column:
    """Zone-free timestamp of an ISO text; one with a UTC offset is the instant, told in UTC."""
    return F.when(text.rlike(OFFSET_AT_END), utc(text.try_cast("timestamp"))).otherwise(text.try_cast("timestamp_ntz"))


def as_ts(x: Column | str) -> Column:
    """Zone-free timestamp from a date, a timestamp or text; null when unreadable."""
    x = col(x)
    text = x.cast("string")
    from_text = F.coalesce(
        iso_ts(text),
        *[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("timestamp_ntz") for f in EXTRA_DATETIME_FORMATS],
    )
    return F.when(is_text(x), from_text).otherwise(x.try_cast("timestamp_ntz"))


def false_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def quote_regex(text: str) -> str:
    r"""Literal text as a Java regex; ``\E`` inside the text is kept intact."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"
