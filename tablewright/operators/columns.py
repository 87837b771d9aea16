"""Projections and column operators: all narrow, all inside the scan's stage."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import FUNCTIONS, OPERATORS, dates, text
from ..functions.attempt import attempt, attempt_struct, can_fail
from ..functions.base import value
from ..functions.logic import ERROR_SUFFIX
from ..plans.names import free_name, ref, require_columns, require_free

MATCH_TYPES = ("prefix", "suffix", "contains", "regex")


def as_column(expression: Column | str | dict) -> Column:
    """Spark SQL text is parsed by Spark; a Column passes through.

    A call of a library function in a configuration is ``{"fn": name, "args": […]}``
    with the arguments the Python function takes; arguments may be calls again.
    """
    if isinstance(expression, dict):
        name, known = expression["fn"], FUNCTIONS | OPERATORS
        if name not in known:
            raise ValueError(f"unknown function: {name}")
        return known[name](*[as_column(a) if isinstance(a, dict) else a for a in expression.get("args", ())])
    return F.expr(expression) if isinstance(expression, str) else expression


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*[ref(c) for c in columns])


def remove(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.drop(*columns)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    require_columns(df, names)
    require_free([names.get(c, c) for c in df.columns], [], "rename")
    return df.withColumnsRenamed(names)


def matching_columns(columns: Sequence[str], pattern: str | Sequence[str], match_type: str) -> list[str]:
    """Names matching any of the patterns; an invalid regex matches nothing."""
    patterns = [pattern] if isinstance(pattern, str) else list(pattern)
    tests: dict[str, Callable[[str, str], bool]] = {
        "prefix": str.startswith,
        "suffix": str.endswith,
        "contains": lambda name, p: p in name,
        "regex": _regex_matches,
    }
    if match_type not in tests:
        raise ValueError(f"match_type must be one of {MATCH_TYPES}")
    return [c for c in columns if any(tests[match_type](c, p) for p in patterns)]


def _regex_matches(name: str, pattern: str) -> bool:
    try:
        return re.search(pattern, name) is not None
    except re.error:
        return False


def select_pattern(df, pattern, match_type: str = "prefix", include: Sequence[str] = ()) -> DataFrame:
    """Matching columns, then ``include``; without a match the table is unchanged."""
    found = matching_columns(df.columns, pattern, match_type)
    keep = [*found, *[c for c in include if c in df.columns and c not in found]]
    return df.select(*[ref(c) for c in keep]) if keep else df


def remove_pattern(df, pattern, match_type: str = "prefix") -> DataFrame:
    found = matching_columns(df.columns, pattern, match_type)
    return df.drop(*found)


def rename_pattern(df: DataFrame, find: str, replace: str, regex: bool = False) -> DataFrame:
    """Replaces the first occurrence in each name; an invalid regex changes nothing."""
    try:
        pattern = re.compile(find if regex else re.escape(find))
        template = re.sub(r"\$(\d+)", r"\\g<\1>", replace) if regex else replace.replace("\\", r"\\")
        renamed = {c: pattern.sub(template, c, count=1) for c in df.columns}
    except re.error:
        return df
    return rename(df, {a: b for a, b in renamed.items() if a != b})


def derive(df: DataFrame, expressions: dict[str, Column | str | dict], errors: bool | str = False) -> DataFrame:
    """Adds or replaces columns in the given order; later ones see earlier ones.

    A cell that fails (a bad cast, a division by zero) is null. With ``errors`` its message is
    in ``<column>__error``, which later replacements, imputations and profiles read;
    ``errors="possible"`` leaves that column out where an expression can't fail.
    """
    for name, expression in expressions.items():
        c = as_column(expression)
        if not errors or (errors == "possible" and not can_fail(df, c)):
            gone = [name + ERROR_SUFFIX] if errors and name + ERROR_SUFFIX in df.columns else []  # of the value it replaces
            df = df.withColumn(name, attempt(df, c)).drop(*gone)
            continue
        # Value and failure come from one evaluation.
        tried = free_name("__tried", df.columns)
        df = df.withColumn(tried, attempt_struct(df, c))
        message = F.when(ref(tried).isNull(), F.lit(f"cannot evaluate {name}"))
        df = df.withColumns({name: ref(tried)["v"], name + ERROR_SUFFIX: message}).drop(tried)
    return df


def conditional(df, column: str, conditions: Sequence[tuple[Column | str, object]], otherwise=None) -> DataFrame:
    """The value of the first condition that is true; a condition that fails is not."""
    result = None
    for when, then in conditions:
        result = (F if result is None else result).when(attempt(df, as_column(when)), attempt(df, value(then)))
    if result is None:
        raise ValueError("conditional needs at least one condition")
    return df.withColumn(column, result.otherwise(attempt(df, value(otherwise))))


def merge(df: DataFrame, columns: Sequence[str], output: str, separator: str = " ") -> DataFrame:
    """Columns joined as text; a null counts as empty and keeps its separator."""
    require_columns(df, columns)
    parts = [F.coalesce(ref(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn(output, F.concat_ws(separator, *parts))


def clean_text(df: DataFrame, column: str, operations: Sequence[str], output: str | None = None) -> DataFrame:
    """``trim`` and one of ``uppercase``, ``lowercase``, ``titlecase`` into ``<column>_text``."""
    cases = {"uppercase": text.upper, "lowercase": text.lower, "titlecase": text.titlecase}
    unknown = set(operations) - {"trim", *cases}
    if unknown or not operations:
        raise ValueError(f"unknown text operations: {sorted(unknown)}")
    c = ref(column)
    if "trim" in operations:
        c = text.trim(c)
    for name, fn in cases.items():
        if name in operations:
            c = fn(c)
            break
    return df.withColumn(output or f"{column}_text", c)


PARTS = {
    "year": dates.year, "month": dates.month, "day": dates.day, "hour": dates.hour, "minute": dates.minute,
    "second": dates.second, "weekday": dates.weekday, "week": dates.week, "quarter": dates.quarter,
}


def date_parts(df: DataFrame, column: str, parts: Sequence[str] = (), truncations: Sequence[str] = ()) -> DataFrame:
    """``<column>_<part>`` and ``<column>_<unit>_trunc`` columns."""
    unknown = [p for p in parts if p not in PARTS]
    if unknown:
        raise ValueError(f"unknown date parts: {unknown}")
    new = {f"{column}_{p}": PARTS[p](ref(column)) for p in parts}
    new |= {f"{column}_{u}_trunc": dates.date_trunc(ref(column), u) for u in truncations}
    return df.withColumns(new)


def parse_dates(df: DataFrame, column: str, fmt: str, output: str | None = None) -> DataFrame:
    """Text in a token format into ``<column>_parsed``; what does not fit is null."""
    return df.withColumn(output or f"{column}_parsed", dates.parse_date(ref(column), fmt))


def parse_dates_report(df: DataFrame, column: str, fmt: str) -> DataFrame:
    """One row: total, parsed, failed (missing values count as failed)."""
    parsed = dates.parse_date(ref(column), fmt)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(parsed.isNotNull()).alias("parsed"),
        F.count_if(parsed.isNull()).alias("failed"),
    )
