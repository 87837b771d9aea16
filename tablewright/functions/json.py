"""JSON text functions on Spark's variant and JSON-path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import as_text, col


def is_json(s) -> Column:
    s = as_text(s)
    return F.when(s.isNotNull(), F.try_parse_json(s).isNotNull())


def json_path(path: str) -> str:
    """``a.0.b`` becomes ``$.a[0].b``; a numeric part is an array position."""
    parts = [p for p in path.split(".") if p != ""]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts)


def json_extract(s, path: str, as_type: str | None = None) -> Column:
    """The value at a dotted path: text by default, or read as ``as_type``."""
    if as_type is None:
        return F.get_json_object(as_text(s), json_path(path))
    return F.try_variant_get(F.try_parse_json(as_text(s)), json_path(path), as_type)


def json_keys(s) -> Column:
    return F.json_object_keys(as_text(s))


def json_array_length(s) -> Column:
    return F.json_array_length(as_text(s))


def json_type(s) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null``."""
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json(as_text(s))), r"^[A-Z]+", 0)
    return (
        F.when(kind == "OBJECT", "object")
        .when(kind == "ARRAY", "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number")
    )


def json_stringify(x, nested: bool = False) -> Column:
    """JSON text of a scalar, or of an array / struct when ``nested``."""
    x = col(x)
    return F.to_json(x) if nested else F.to_json(x.cast("variant"))
