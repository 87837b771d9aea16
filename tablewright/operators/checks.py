"""Schema reports, schema differences and source contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .types import infer_types

FINDING = "source string, kind string, column string, expected string, actual string, message string"


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column with its inferred type, and the table's row and column count."""
    found = infer_types(df)
    lines = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type")) for i, (c, t) in enumerate(found.items(), 1)]
    )
    return (
        df.agg(F.count(F.lit(1)).alias("rows"))
        .select(F.explode(lines).alias("l"), "rows", F.lit(len(found)).alias("columns"))
        .select("l.*", "rows", "columns")
    )


def schema_diff(before: DataFrame, after: DataFrame, infer: bool = True) -> DataFrame:
    """Columns missing, new, or of another type in ``after``."""
    from .types import physical_schema

    a = infer_types(before) if infer else physical_schema(before)
    b = infer_types(after) if infer else physical_schema(after)
    lines = [("missing", c, t, None) for c, t in a.items() if c not in b]
    lines += [("new", c, None, t) for c, t in b.items() if c not in a]
    lines += [("type_changed", c, t, b[c]) for c, t in a.items() if c in b and b[c] != t]
    return before.sparkSession.createDataFrame(lines, "change string, column string, old_type string, new_type string")


def contract_check(
    df: DataFrame, expected: dict[str, str] | Sequence[tuple[str, str]], source: str = "source", delimiter: str = ","
) -> DataFrame:
    """Findings where the table does not keep its contract of columns and types."""
    expected = dict(expected)
    actual = infer_types(df)
    lines = []
    for name, kind in expected.items():
        if name in actual:
            if actual[name] != kind:
                lines.append((source, "type_mismatch", name, kind, actual[name], f"column {name}: expected {kind}, found {actual[name]}"))
            continue
        twin = next((c for c in actual if c.lower() == name.lower()), None)
        if twin:
            lines.append((source, "column_case_mismatch", name, name, twin, f"expected column {name}, found {twin}"))
        else:
            lines.append((source, "missing_column", name, name, None, f"expected column {name} not found"))
    if len(actual) == 1 and len(expected) > 1:
        text = f"{len(expected)} columns expected but the file has 1; its delimiter may not be {delimiter!r}"
        lines.append((source, "delimiter_mismatch", None, str(len(expected)), "1", text))
    return df.sparkSession.createDataFrame(lines, FINDING)


def require_contract(df: DataFrame, expected, source: str = "source", delimiter: str = ",") -> DataFrame:
    """The table itself, or an error that lists every finding."""
    findings = contract_check(df, expected, source, delimiter).collect()
    if findings:
        raise ValueError("; ".join(f"{f['source']}: {f['message']}" for f in findings))
    return df
