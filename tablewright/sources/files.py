"""CSV and JSON in and out, through Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.logic import ERROR_SUFFIX
from ..operators.types import infer_types, types
from ..plans.names import ref, repair_headers

HEADER_MODES = ("first-row", "auto-generate", "manual")

# Delimiters tried when none is given.
DELIMITERS = (",", "\t", "|", ";")
RAGGED = "_ragged"


def detect_delimiter(spark: SparkSession, path, encoding: str = "UTF-8") -> str:
    """The candidate that occurs most in the first line."""
    row = spark.read.csv(path, sep="\u0001", quote="", header=False, encoding=encoding).first()
    line = row[0] if row and row[0] else ""
    best = max(DELIMITERS, key=line.count)
    return best if best in line else DELIMITERS[0]


def has_open_quotes(spark: SparkSession, path, encoding: str = "UTF-8") -> bool:
    """A line holds an odd number of quotes: a quoted cell goes on in the next one, as far as lines can tell."""
    if encoding.upper().replace("-", "") not in ("UTF8", "ASCII", "USASCII", "ISO88591", "LATIN1", "WINDOWS1252"):
        return True  # lines of wider encodings can't be told apart by bytes
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def detect_format(spark: SparkSession, path: str) -> str:
    """parquet, json, jsonl or csv: by suffix, otherwise (a folder of parts) by its first line."""
    for suffix in ("parquet", "jsonl", "json", "csv", "tsv", "txt"):
        if path.endswith(f".{suffix}"):
            return suffix if suffix in ("parquet", "jsonl", "json") else "csv"
    row = spark.read.text(path).filter(F.length(F.trim("value")) > 0).first()
    return "jsonl" if row and row[0].lstrip().startswith("{") else "csv"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str | None = None,
    header: str = "first-row",
    names: Sequence[str] = (),
    skip_first: bool = True,
    encoding: str = "UTF-8",
    infer: bool = True,
    column_types: dict[str, str] | None = None,
    strict: bool = True,
    keep_ragged: bool = False,
    multiline: bool | None = None,
) -> DataFrame:
    """A CSV file or folder as a table.

    Header modes: ``first-row`` (repeated names get ``_2``, ``_3``),
    ``auto-generate`` (``column_1``, …), ``manual`` (``names``; ``skip_first``
    says whether the first row is a header to drop). Values are typed by one
    pass over all rows, or by ``column_types`` without that pass. Rows with too few
    or too many fields fail the read. ``keep_ragged`` keeps such rows' text in ``_ragged``
    (to be read beside another column); without ``strict`` short rows end in nulls and long
    rows lose the excess. Quoted line breaks need ``multiline``, which keeps Spark from
    splitting a file; by default one pass over the lines finds out whether a quote is left open.
    """
    if header not in HEADER_MODES:
        raise ValueError(f"header must be one of {HEADER_MODES}")
    sep = delimiter or detect_delimiter(spark, path, encoding)
    strict = strict and not keep_ragged
    if multiline is None:
        multiline = has_open_quotes(spark, path, encoding)
    first = spark.read.csv(path, sep=sep, header=False, encoding=encoding, multiLine=multiline, escape='"').first()
    found = list(first) if first else []
    if header == "manual":
        if not names:
            raise ValueError("manual headers need names")
        columns = list(names)
    elif header == "auto-generate":
        columns = [f"column_{i + 1}" for i in range(len(found))]
    else:
        columns = repair_headers(found)
    has_header = header == "first-row" or (header == "manual" and skip_first)
    fields = [T.StructField(c, T.StringType()) for c in columns]
    if keep_ragged:
        fields.append(T.StructField(RAGGED, T.StringType()))
    # A row's shape is only judged when all its columns are parsed.
    df = spark.read.options(columnPruning=not (keep_ragged or strict)).csv(
        path,
        schema=T.StructType(fields),
        sep=sep,
        header=has_header,
        encoding=encoding,
        enforceSchema=True,
        multiLine=multiline,
        escape='"',
        mode="FAILFAST" if strict else "PERMISSIVE",
        columnNameOfCorruptRecord=RAGGED,
    )
    if column_types is not None:
        return types(df, column_types)
    if infer:
        body = df.select(*[ref(c) for c in columns])
        df = types(df, {c: t for c, t in infer_types(body).items() if t not in ("string", "json")})
    return df


def read_json(
    spark: SparkSession,
    path: str | list[str],
    record_path: str = "",
    flatten_nested: bool = False,
    serialize: bool = False,
    lines: bool = False,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Records of a JSON document (or of JSON Lines) as a table.

    ``record_path`` is a dotted path to the record array; numeric parts are array
    positions.
    """
    df = spark.read.json(path, schema=schema, multiLine=not lines)
    parts = [p for p in record_path.split(".") if p]
    if parts:
        if parts[0].isdigit():
            raise ValueError("a top-level array is read as rows: start the path with a field name")
        c = ref(parts[0])
        for p in parts[1:]:
            c = F.get(c, F.lit(int(p))) if p.isdigit() else c.getField(p)
        df = df.select(c.alias("r"))
        if isinstance(df.schema["r"].dataType, T.ArrayType):
            df = df.select(F.explode("r").alias("r"))
        if isinstance(df.schema["r"].dataType, T.StructType):
            df = df.select("r.*")
    if flatten_nested:
        df = flatten(df)
    return serialize_nested(df) if serialize else df


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as ``outer_inner`` columns, at any depth; arrays stay."""

    def leaves(t: T.StructType, column, prefix: str):
        for f in t.fields:
            inner = ref(f.name) if column is None else column.getField(f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, inner, f"{prefix}{f.name}_")
            else:
                yield inner, f"{prefix}{f.name}"

    found = list(leaves(df.schema, None, ""))
    names = repair_headers([n for _, n in found])
    return df.select(*[c.alias(n) for (c, _), n in zip(found, names)])


def _is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.StructType, T.MapType, T.VariantType))


def serialize_nested(df: DataFrame) -> DataFrame:
    """Arrays, structs, maps and variants as JSON text."""
    return df.select(
        *[F.to_json(ref(f.name)).alias(f.name) if _is_nested(f.dataType) else ref(f.name) for f in df.schema.fields]
    )


def without_errors(df: DataFrame) -> DataFrame:
    """The table as exported: failed cells are already null, their messages go."""
    return df.drop(*[c for c in df.columns if c.endswith(ERROR_SUFFIX)])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists") -> None:
    """A folder of CSV part files with headers, written by all tasks."""
    flat = serialize_nested(without_errors(df))
    flat.write.mode(mode).options(
        sep=delimiter,
        header=True,
        escape='"',
        dateFormat="yyyy-MM-dd",
        timestampFormat="yyyy-MM-dd'T'HH:mm:ss",
        timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss",
    ).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON Lines part files, one object per row, nulls written."""
    without_errors(df).write.mode(mode).options(ignoreNullFields=False).json(path)
