"""Column functions for derive and filter: 72 named functions plus the operators.

``FUNCTIONS`` and ``OPERATORS`` map each public name to its builder; names that would shadow a
Python builtin carry a trailing underscore as attributes.
"""

from . import dates, json, logic, math, regex, text
from .base import as_text, as_ts, col, num
from .dates import (
    date_add, date_trunc, day, days_between, format_date, hour, minute, month, now, parse_date,
    quarter, second, today, week, weekday, year,
)
from .json import is_json, json_array_length, json_extract, json_keys, json_stringify, json_type
from .logic import coalesce, eq, if_, is_error, is_nan, ne, not_, parse_float, parse_int
from .math import (
    abs_, acos, asin, atan, atan2, cbrt, ceil, cos, degrees, divide, e, exp, floor, ln, log2, log10,
    max_, min_, mod, pi, pow_, radians, round_, sign, sin, sqrt, tan, trunc,
)
from .regex import regexp_extract, regexp_match, regexp_replace
from .text import (
    concat, contains, contains_ci, ends_with, ends_with_ci, equals, equals_ci, length, lower, split,
    starts_with, starts_with_ci, substring, titlecase, trim, upper,
)

_STRING = dict(
    upper=upper, lower=lower, titlecase=titlecase, trim=trim, substring=substring, len=length, split=split,
    equals=equals, contains=contains, starts_with=starts_with, ends_with=ends_with, equals_ci=equals_ci,
    contains_ci=contains_ci, starts_with_ci=starts_with_ci, ends_with_ci=ends_with_ci,
)
_REGEX = dict(regexp_match=regexp_match, regexp_extract=regexp_extract, regexp_replace=regexp_replace)
_DATE = dict(
    year=year, month=month, day=day, hour=hour, minute=minute, second=second, weekday=weekday, week=week,
    quarter=quarter, today=today, now=now, days_between=days_between, date_add=date_add,
    date_trunc=date_trunc, format_date=format_date, parse_date=parse_date,
)
_MATH = dict(
    abs=abs_, pow=pow_, sqrt=sqrt, cbrt=cbrt, exp=exp, ln=ln, log10=log10, log2=log2, sin=sin, cos=cos,
    tan=tan, asin=asin, acos=acos, atan=atan, atan2=atan2, radians=radians, degrees=degrees, sign=sign,
    trunc=trunc, pi=pi, e=e, round=round_, floor=floor, ceil=ceil, min=min_, max=max_,
)
_LOGIC = dict(
    parse_int=parse_int, parse_float=parse_float, is_nan=is_nan, is_error=is_error, coalesce=coalesce,
)
_LOGIC["if"] = if_
_JSON = dict(
    is_json=is_json, json_extract=json_extract, json_keys=json_keys, json_array_length=json_array_length,
    json_type=json_type, json_stringify=json_stringify,
)
FUNCTIONS = {**_STRING, **_REGEX, **_DATE, **_MATH, **_LOGIC, **_JSON}
OPERATORS = {"divide": divide, "mod": mod, "eq": eq, "ne": ne, "not": not_, "concat": concat}
