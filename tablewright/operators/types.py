"""Type conversion with error columns, type inference and promotion.

A cell that cannot be converted becomes null, and with ``errors=True`` its
message goes to ``<column>__error``. Only ``try_`` expressions are used, so ANSI
mode stays on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import NUMBER_TEXT, as_ts, iso_ts
from ..functions.logic import ERROR_SUFFIX
from ..plans.names import ref
from ..streaming import require_batch

# Logical types and their Spark form; words read as boolean.
LOGICAL_TYPES = {
    "string": "string",
    "integer": "bigint",
    "float": "double",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
    "json": "string",
}
TRUE_TEXT = r"^\s*(?i:true|1|yes|y|on)\s*$"
FALSE_TEXT = r"^\s*(?i:false|0|no|n|off)\s*$"

# Shapes of text that inference recognizes.
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
LEADING_ZERO_TEXT = r"^\s*[+-]?0\d+"
DATETIME_TEXT = r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?\s*$"
ISO_DATE_TEXT, YEAR_FIRST_TEXT, YEAR_LAST_TEXT = r"^\s*\d{4}-\d{2}-\d{2}\s*$", r"^\s*\d{4}/\d{2}/\d{2}\s*$", r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$"
JSON_TEXT = r"^\s*[\[{]"
BOOLEAN_TEXT = r"^\s*(?i:true|false)\s*$"


def physical_type(t: T.DataType) -> str:
    """The logical type of a Spark type."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, T.NumericType):
        return "float"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return "json"
    return "string"


def physical_schema(df: DataFrame) -> dict[str, str]:
    return {f.name: physical_type(f.dataType) for f in df.schema.fields}


def promote(a: str, b: str) -> str:
    """The logical type that holds both."""
    if a == b:
        return a
    if {a, b} == {"integer", "float"}:
        return "float"
    if {a, b} == {"date", "datetime"}:
        return "datetime"
    return "string"


def _number(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.when(c, 1.0).when(~c, 0.0)
    if kind in ("date", "datetime"):
        return F.unix_millis(c.cast("timestamp")).cast("double")
    if kind == "string":
        parsed = F.when(c.rlike(NUMBER_TEXT), c.try_cast("double"))
        return F.when(F.abs(parsed) < float("inf"), parsed)
    return c.try_cast("double")


def to_string(c: Column, kind: str) -> Column:
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "datetime":
        midnight = c.cast("timestamp_ntz") == F.date_trunc("day", c).cast("timestamp_ntz")
        return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    return F.to_json(c) if kind == "json" else c.cast("string")


def to_integer(c: Column, kind: str) -> Column:
    """Truncates toward zero; text may be in scientific form."""
    if kind == "integer":
        return c.cast("bigint")
    if kind == "string":
        exact = F.when(c.rlike(INTEGER_TEXT), c.try_cast("bigint"))
        return F.coalesce(exact, _number(c, kind).try_cast("bigint"))
    return _number(c, kind).try_cast("bigint")


def to_float(c: Column, kind: str) -> Column:
    return _number(c, kind)


def to_decimal(c: Column, kind: str, target: str) -> Column:
    """Text is rounded to the scale; a number too large for the precision fails."""
    if kind == "string":
        return F.when(c.rlike(NUMBER_TEXT), F.trim(c).try_cast(target))
    return (c if kind in ("integer", "float") else _number(c, kind)).try_cast(target)


def to_boolean(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return c
    if kind in ("integer", "float"):
        n = c.cast("double")
        return (n != 0) & ~F.isnan(n) & (F.abs(n) < float("inf"))
    if kind in ("date", "datetime"):
        return F.when(c.isNotNull(), True)
    text = c.cast("string")
    return F.when(text.rlike(TRUE_TEXT), True).when(text.rlike(FALSE_TEXT), False).otherwise(_number(text, "string") != 0)


def to_date(c: Column, kind: str) -> Column:
    if kind in ("integer", "float"):
        return F.timestamp_millis(c.cast("bigint")).cast("date")
    return as_ts(c).cast("date") if kind == "string" else c.try_cast("date")


def to_datetime(c: Column, kind: str) -> Column:
    if kind in ("integer", "float"):
        return F.timestamp_millis(c.cast("bigint")).cast("timestamp_ntz")
    return as_ts(c) if kind == "string" else c.try_cast("timestamp_ntz")


def to_json(c: Column, kind: str) -> Column:
    if kind == "json":
        return F.to_json(c)
    if kind == "string":
        return F.when(F.try_parse_json(c).isNotNull(), c)
    return to_string(c, kind) if kind in ("integer", "float", "boolean") else F.lit(None).cast("string")


CONVERTERS = {
    "string": to_string, "integer": to_integer, "float": to_float, "boolean": to_boolean, "date": to_date,
    "datetime": to_datetime, "json": to_json,
}


def convert(c: Column, kind: str, target: str) -> tuple[Column, Column]:
    """(converted value, error message or null) for a column of logical type ``kind``."""
    decimal = re.fullmatch(r"decimal\(\d+,\d+\)", target)
    if target not in CONVERTERS and not decimal:
        raise ValueError(f"unknown type {target}; one of {tuple(CONVERTERS)} or decimal(p,s)")
    blank = c.rlike(r"^\s*$") if kind == "string" else F.lit(False)
    converted = to_decimal(c, kind, target) if decimal else CONVERTERS[target](c, kind)
    if target not in ("string",):
        converted = F.when(~blank, converted)
    excused = c.isNull() if target in ("string", "json") else (c.isNull() | blank)
    shown = to_string(c, kind) if kind != "json" else F.to_json(c)
    message = F.concat(F.lit('cannot convert "'), shown, F.lit(f'" to {target}'))
    return converted, F.when(converted.isNull() & ~excused, message)


def types(df: DataFrame, targets: dict[str, str], errors: bool = False) -> DataFrame:
    """Converts columns; unknown columns are skipped."""
    new: dict[str, Column] = {}
    for name, target in targets.items():
        if name in df.columns:
            converted, message = convert(ref(name), physical_type(df.schema[name].dataType), target)
            new[name] = converted
            if errors:
                new[name + ERROR_SUFFIX] = message
    return df.withColumns(new) if new else df


# What one cell's text looks like; a column's answer is the set of classes in it.
BOOLEAN, INTEGER, ZERO_LED, FLOAT, JSON, BAD_JSON, DATETIME, DATE, OTHER, WIDE = (1 << i for i in range(10))
DOUBLE_WHOLE = 1 << 53  # whole numbers up to this are doubles too


def _text_class(c: Column) -> Column:
    """One class per cell, 0 when empty. The first fitting branch ends the work.

    A cell has a class only if its converter gives a value: whole numbers beyond 64 bits
    and dates that don't exist stay text. Whole numbers that a double may change are a class of their own.
    """
    whole = c.try_cast("bigint")
    finite = F.abs(c.try_cast("double")) < float("inf")
    number = F.when(c.rlike(LEADING_ZERO_TEXT), ZERO_LED)
    as_whole = number.when(whole.between(-DOUBLE_WHOLE, DOUBLE_WHOLE), INTEGER).when(whole.isNotNull(), WIDE).otherwise(OTHER)
    day_first = F.try_to_timestamp(F.trim(c), F.lit("yyyy/M/d"))
    return (
        F.when(c.isNull() | (c == ""), 0)
        .when(c.rlike(INTEGER_TEXT), as_whole)
        .when(c.rlike(NUMBER_TEXT), number.when(finite, FLOAT).otherwise(OTHER))
        .when(c.rlike(JSON_TEXT), F.when(F.try_parse_json(c).isNotNull(), JSON).otherwise(BAD_JSON))
        .when(c.rlike(ISO_DATE_TEXT), F.when(c.try_cast("date").isNotNull(), DATE).otherwise(OTHER))
        .when(c.rlike(YEAR_FIRST_TEXT), F.when(day_first.isNotNull(), DATE).otherwise(OTHER))
        .when(c.rlike(YEAR_LAST_TEXT), F.when(F.try_to_timestamp(F.trim(c), F.lit("M/d/yyyy")).isNotNull(), DATE).otherwise(OTHER))
        .when(c.rlike(DATETIME_TEXT), F.when(iso_ts(c).isNotNull(), DATETIME).otherwise(OTHER))
        .when(c.rlike(BOOLEAN_TEXT), BOOLEAN)
        .otherwise(OTHER)
    )


def _column_type(seen: int, keep_leading_zeros: bool) -> str:
    """The type that keeps every cell; ``decimal`` where whole numbers a double may change stand beside fractions."""

    def only(*classes: int) -> bool:
        return seen != 0 and seen & ~sum(classes) == 0

    zero_led = () if keep_leading_zeros else (ZERO_LED,)
    if only(JSON, BAD_JSON):
        return "json" if seen & JSON else "string"
    if only(BOOLEAN):
        return "boolean"
    if only(INTEGER, WIDE, *zero_led):
        return "integer"
    if only(INTEGER, FLOAT, *zero_led):
        return "float"
    if only(INTEGER, WIDE, FLOAT, *zero_led):
        return "decimal"
    if only(DATE):
        return "date"
    return "datetime" if only(DATE, DATETIME) else "string"


def _decimal_types(df: DataFrame, names: list[str]) -> dict[str, str]:
    """The narrowest exact decimal of each column; text where 38 digits don't do or an exponent is used."""
    new = []
    for i, n in enumerate(names):
        c = ref(n).cast("string")
        new += [
            F.max(F.char_length(F.regexp_extract(c, r"^\s*[+-]?0*(\d*)", 1))).alias(f"whole_{i}"),
            F.max(F.char_length(F.regexp_extract(c, r"\.(\d*)", 1))).alias(f"part_{i}"),
            F.max(c.rlike("[eE]")).alias(f"power_{i}"),
        ]
    row = df.agg(*new).first()
    out = {}
    for i, n in enumerate(names):
        whole, part = row[f"whole_{i}"], row[f"part_{i}"]
        fits = not row[f"power_{i}"] and whole + part <= 38
        out[n] = f"decimal({max(1, whole + part)},{part})" if fits else "string"
    return out


def infer_types(df: DataFrame, keep_leading_zeros: bool = True) -> dict[str, str]:
    """Logical type of every column, text columns by their values.

    One aggregate over all rows and all text columns: the union of the classes of
    a column's cells. A type holds only if every present value has it, and only if it keeps
    every value: columns of fractions with whole numbers beyond 2^53 are ``decimal(p,s)``,
    with the digits found by a second aggregate over just these columns.
    """
    require_batch(df, "infer_types")
    found = physical_schema(df)
    texts = [c for c, t in found.items() if t == "string"]
    if texts:
        row = df.agg(*[F.bit_or(_text_class(ref(c).cast("string"))) for c in texts]).first()
        found |= {c: _column_type(seen or 0, keep_leading_zeros) for c, seen in zip(texts, row)}
        wide = [c for c, t in found.items() if t == "decimal"]
        found |= _decimal_types(df, wide) if wide else {}
    return found
