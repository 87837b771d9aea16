"""Date functions. Input may be a date, a timestamp, or text holding either."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import as_text, as_ts, value

DATE_UNITS = ("year", "quarter", "month", "week", "day")
TIME_UNITS = ("hour", "minute", "second")

# Format tokens and what each means to Spark's date patterns.
FORMAT_TOKENS = {
    "YYYY": "yyyy",
    "YY": "yy",
    "MM": "MM",
    "M": "M",
    "DD": "dd",
    "D": "d",
    "HH": "HH",
    "H": "H",
    "mm": "mm",
    "m": "m",
    "ss": "ss",
    "s": "s",
}
CENTURY_PIVOT = 69  # two-digit years up to 69 are 20xx, from 70 on 19xx


def spark_pattern(fmt: str) -> str:
    """Token format as a Spark pattern; letters that are no token are quoted."""
    pieces = re.findall("|".join(FORMAT_TOKENS) + "|.", fmt, flags=re.S)
    out = []
    for p in pieces:
        if p in FORMAT_TOKENS:
            out.append(FORMAT_TOKENS[p])
        elif p == "'":
            out.append("''")
        else:
            out.append(f"'{p}'" if p.isalpha() or p in "[]{}#" else p)
    return "".join(out)


def year(d) -> Column:
    return F.year(as_ts(d))


def month(d) -> Column:
    return F.month(as_ts(d))


def day(d) -> Column:
    return F.dayofmonth(as_ts(d))


def hour(d) -> Column:
    return F.hour(as_ts(d))


def minute(d) -> Column:
    return F.minute(as_ts(d))


def second(d) -> Column:
    return F.second(as_ts(d))


def weekday(d) -> Column:
    """0 is Monday."""
    return F.weekday(as_ts(d))


def week(d) -> Column:
    """ISO week number."""
    return F.weekofyear(as_ts(d))


def quarter(d) -> Column:
    return F.quarter(as_ts(d))


def today() -> Column:
    return F.current_date()


def now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def days_between(start, end) -> Column:
    return F.datediff(as_ts(end), as_ts(start))


def date_add(d, amount, unit: str) -> Column:
    """Day, month and year steps give a date, finer ones a timestamp.

    Months overflow into the next month: January 31 plus one month is the
    31st day counted from February 1.
    """
    unit = unit.lower().rstrip("s")
    ts, n = as_ts(d), value(amount).cast("int")
    if unit == "day":
        return F.date_add(ts.cast("date"), n)
    if unit in ("month", "year"):
        date = ts.cast("date")
        months = n * F.lit(12) if unit == "year" else n
        return F.date_add(F.add_months(F.trunc(date, "MM"), months), F.dayofmonth(date) - F.lit(1))
    if unit in TIME_UNITS:
        return ts + F.make_dt_interval(
            hours=n if unit == "hour" else F.lit(0),
            mins=n if unit == "minute" else F.lit(0),
            secs=n.cast("decimal(18,6)") if unit == "second" else F.lit(0).cast("decimal(18,6)"),
        )
    raise ValueError(f"unknown unit: {unit}")


def date_trunc(d, unit: str, step: int = 1) -> Column:
    """Start of the period; ``step`` bins hours, minutes or seconds within their parent."""
    unit, step, ts = unit.lower(), max(int(step or 1), 1), as_ts(d)
    if unit in DATE_UNITS:
        return F.date_trunc(unit, ts).cast("date")
    if unit not in TIME_UNITS:
        raise ValueError(f"unknown unit: {unit}")
    if step == 1:
        return F.date_trunc(unit, ts).cast("timestamp_ntz")
    parent = {"hour": "day", "minute": "hour", "second": "minute"}[unit]
    part = {"hour": F.hour, "minute": F.minute, "second": F.second}[unit](ts)
    binned = part - part % F.lit(step)
    return date_add(F.date_trunc(parent, ts).cast("timestamp_ntz"), binned, unit)


def format_date(d, fmt: str) -> Column:
    return F.date_format(as_ts(d), spark_pattern(fmt))


def parse_date(s, fmt: str) -> Column:
    """Strict parse of text in a token format; null when it does not fit.

    A date, or a timestamp when the format has a time token.
    """
    tokens = re.findall("|".join(FORMAT_TOKENS), fmt)
    if not {"Y", "M", "D"} <= {t[0] for t in tokens}:
        return F.lit(None).cast("date")
    parsed = F.try_to_timestamp(F.trim(as_text(s)), F.lit(spark_pattern(fmt))).cast("timestamp_ntz")
    if "YY" in tokens:
        late = F.year(parsed) > F.lit(2000 + CENTURY_PIVOT)
        parsed = F.when(late, parsed - F.make_ym_interval(F.lit(100), F.lit(0))).otherwise(parsed)
    has_time = any(t[0] in "Hms" for t in tokens)
    return parsed if has_time else parsed.cast("date")
