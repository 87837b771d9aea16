"""Batch jobs from a configuration: ordered steps, named tables, declared outputs.

A step is a one-key mapping from an operator's name to its options; expressions
in it are Spark SQL text (or Columns). A job only builds lazy DataFrames, so Spark
plans each output as one query.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .. import operators as op
from ..operators.columns import as_column
from ..sources import files

Tables = Mapping[str, DataFrame]


def _order(spec) -> list[tuple[str, str]]:
    """``"a"``, ``["a"]``, ``{"field": "a", "order": "desc"}`` or a list of those."""
    items = [spec] if isinstance(spec, (str, dict)) else list(spec)
    return [(i, "asc") if isinstance(i, str) else (i["field"], i.get("order", "asc")) for i in items]


def _optional_order(o: dict):
    return _order(o["orderBy"]) if o.get("orderBy") else None


def _replace(df: DataFrame, o: dict) -> DataFrame:
    if o.get("matchMode") == "null":
        return op.replace_nulls(df, o["column"], o["replace"])
    if o.get("matchMode") == "errors":
        return op.replace_errors(df, o["column"], o["replace"])
    act = op.replace_regex if o.get("isRegex") else op.replace_value
    return act(df, o["column"], o["find"], o["replace"])


def _join(df: DataFrame, o: dict, tables: Tables) -> DataFrame:
    pairs = [p if isinstance(p, str) else tuple(p) for p in o.get("on", [])]
    suffixes = tuple(o.get("suffixes") or ("_x", "_y"))
    return op.join(df, _table(tables, o["right"]), pairs, o.get("how", "inner"), suffixes)


def _pairs(o: dict) -> list:
    return [p if isinstance(p, str) else tuple(p) for p in o["on"]]


def _table(tables: Tables, name: str) -> DataFrame:
    if name not in tables:
        raise ValueError(f"unknown table {name}; known: {sorted(tables)}")
    return tables[name]


STEPS: dict[str, Callable[[DataFrame, Any, Tables], DataFrame]] = {
    "select": lambda df, o, t: op.select(df, o),
    "remove": lambda df, o, t: op.remove(df, o),
    "rename": lambda df, o, t: op.rename(df, o),
    "selectPattern": lambda df, o, t: op.select_pattern(df, o["pattern"], o["matchType"], o.get("include", ())),
    "removePattern": lambda df, o, t: op.remove_pattern(df, o["pattern"], o["matchType"]),
    "renamePattern": lambda df, o, t: op.rename_pattern(df, o["find"], o["replace"], o.get("regex", False)),
    "derive": lambda df, o, t: op.derive(df, o, errors="possible"),
    "conditional": lambda df, o, t: op.conditional(
        df, o["column"], [(c["when"], as_column(c["then"])) for c in o["conditions"]],
        as_column(o["else"]) if "else" in o else None,
    ),
    "filter": lambda df, o, t: op.filter_rows(df, o),
    "replace": lambda df, o, t: _replace(df, o),
    "sort": lambda df, o, t: op.sort(df, _order(o)),
    "sliceRows": lambda df, o, t: op.slice_rows(df, o["count"], o["mode"], _order(o["orderBy"])),
    "addIndex": lambda df, o, t: op.add_index(df, o["columnName"], _order(o["orderBy"]), o.get("startFrom", 1)),
    "dedupe": lambda df, o, t: op.dedupe(df, o.get("columns", ()), _optional_order(o), o.get("mode", "remove")),
    "sample": lambda df, o, t: op.sample(df, o["count"], o.get("seed"), o.get("keys", ())),
    "removeRows": lambda df, o, t: op.remove_rows(df, o["indices"], _order(o["orderBy"])),
    "keepRows": lambda df, o, t: op.keep_rows(df, o["indices"], _order(o["orderBy"])),
    "promoteHeader": lambda df, o, t: op.promote_header(df, _order(o["orderBy"]), o.get("skipRows", 0)),
    "join": _join,
    "semijoin": lambda df, o, t: op.semijoin(df, _table(t, o["right"]), _pairs(o)),
    "antijoin": lambda df, o, t: op.antijoin(df, _table(t, o["right"]), _pairs(o)),
    "lookup": lambda df, o, t: op.lookup(df, _table(t, o["right"]), _pairs(o), o["values"], _optional_order(o)),
    "concat": lambda df, o, t: op.concat(df, _table(t, o["with"]), o.get("columns", ()), o.get("targetColumns", ())),
    "union": lambda df, o, t: op.union(df, _table(t, o["with"]), o.get("columns", ()), o.get("targetColumns", ())),
    "aggregate": lambda df, o, t: op.aggregate(
        df, {k: v if isinstance(v, str) else tuple(v) for k, v in o["rollup"].items()}, o.get("groupby", ()),
        _optional_order(o),
    ),
    "describe": lambda df, o, t: op.describe(df, o["columns"]),
    "window": lambda df, o, t: op.window(
        df, o["derive"], _order(o["orderBy"]), o.get("partitionBy", ()), o.get("frames")
    ),
    "types": lambda df, o, t: op.types(df, o, errors=True),
    "impute": lambda df, o, t: op.impute(
        df, o["column"], o["strategy"], o.get("value"), _optional_order(o), o.get("includeEmptyString", False)
    ),
    "fold": lambda df, o, t: op.fold(df, o["columns"], tuple(o.get("as", ("key", "value")))),
    "pivot": lambda df, o, t: op.pivot(
        df, o.get("rows", ()), o["keys"], o["values"], o.get("aggregation", "sum"),
        o.get("options", {}).get("sort", True), o.get("options", {}).get("limit"),
    ),
    "split": lambda df, o, t: op.split(
        df, o["column"], o["delimiter"], o.get("mode", "spread"), o.get("maxColumns"), o.get("isRegex", False),
        o.get("keepOriginal", False),
    ),
    "spread": lambda df, o, t: op.spread(df, o["column"], o.get("limit"), o.get("keepOriginal", False)),
    "unroll": lambda df, o, t: op.unroll(df, o["column"], o.get("indices", False), o.get("keepOriginal", False)),
    "import": lambda df, o, t: df,
}


def apply_step(df: DataFrame, step: Mapping[str, Any], tables: Tables | None = None) -> DataFrame:
    """One step; a step of unknown name is skipped with a warning."""
    known = [k for k in step if k in STEPS]
    if not known:
        warnings.warn(f"step skipped, no known operator: {sorted(step)}", stacklevel=2)
        return df
    return STEPS[known[0]](df, step[known[0]], tables or {})


def run_steps(df: DataFrame, steps: Sequence[Mapping[str, Any]], tables: Tables | None = None) -> DataFrame:
    return reduce(lambda d, s: apply_step(d, s, tables), steps, df)


REFERENCES = {"join": "right", "semijoin": "right", "antijoin": "right", "lookup": "right", "concat": "with", "union": "with"}


def _needs(model: Mapping[str, Any]) -> list[str]:
    """Tables a model reads: its input and the right sides of its steps."""
    right = [step[k][f] for step in model.get("steps", ()) for k, f in REFERENCES.items() if k in step]
    return [model["source"], *right]


def check_job(job: Mapping[str, Any]) -> None:
    """Sources, models and outputs exist and refer to each other; no cycles."""
    sources, models, outputs = job.get("sources", {}), job.get("models", {}), job.get("outputs", [])
    problems = [f"the job has no {k}" for k, v in (("sources", sources), ("models", models), ("outputs", outputs)) if not v]
    problems += [f"output {o} is not a model" for o in outputs if o not in models]
    problems += [f"{n} is both a source and a model" for n in models if n in sources]
    for name, model in models.items():
        problems += [f"model {name} reads unknown table {n}" for n in _needs(model) if n not in models and n not in sources]
    if problems:
        raise ValueError("; ".join(problems))


def build_models(job: Mapping[str, Any], sources: Tables) -> dict[str, DataFrame]:
    """Lazy DataFrames of the models the outputs need, by name."""
    check_job(job)
    built: dict[str, DataFrame] = {}
    open_: list[str] = []

    def table(name: str) -> DataFrame:
        if name not in job["models"]:
            return _table(sources, name)
        if name in open_:
            raise ValueError(f"models depend on each other: {' -> '.join([*open_, name])}")
        if name not in built:
            open_.append(name)
            model = job["models"][name]
            needed = {n: table(n) for n in _needs(model)}
            built[name] = run_steps(needed[model["source"]], model.get("steps", ()), needed)
            open_.pop()
        return built[name]

    for output in job["outputs"]:
        table(output)
    return built


def shared_models(job: Mapping[str, Any], built: Tables) -> list[str]:
    """Models read by two or more others or by an output and another model."""
    uses = [n for m in built for n in set(_needs(job["models"][m]))] + list(job["outputs"])
    return [m for m in built if uses.count(m) > 1]


def bind_sources(spark: SparkSession, job: Mapping[str, Any], paths: Mapping[str, str], strict: bool = False) -> dict[str, DataFrame]:
    """Source tables from files; declared columns are checked, ``strict`` makes findings fatal."""
    missing = [n for n in job["sources"] if n not in paths]
    if missing:
        raise ValueError(f"no file is bound to sources {missing}")
    tables = {}
    for name, source in job["sources"].items():
        path, parsing = paths[name], source.get("parsing", {})
        kind = source.get("format") or files.detect_format(spark, path)
        if kind == "parquet":
            df = spark.read.parquet(path)
        elif kind in ("json", "jsonl"):
            df = files.read_json(spark, path, parsing.get("path", ""), True, True, kind == "jsonl")
        else:
            df = files.read_csv(
                spark, path, parsing.get("delimiter"), parsing.get("headerMode", "first-row"),
                parsing.get("customHeaders", ()), parsing.get("skipFirstRow", True), encoding=parsing.get("encoding", "UTF-8"),
                strict=parsing.get("strict", True), keep_ragged=parsing.get("keepRagged", False), multiline=parsing.get("multiline"),
            )
        expected = {c["name"]: c["type"] for c in source.get("columns", ())}
        if expected:
            if strict:
                op.require_contract(df, expected, name, parsing.get("delimiter", ","))
            else:
                for f in op.contract_check(df, expected, name, parsing.get("delimiter", ",")).collect():
                    warnings.warn(f"{f['source']}: {f['message']}", stacklevel=2)
        tables[name] = df
    return tables


def run_job(
    spark: SparkSession,
    job: Mapping[str, Any],
    paths: Mapping[str, str],
    output_dir: str,
    fmt: str = "csv",
    strict: bool = False,
    mode: str = "errorifexists",
) -> dict[str, str]:
    """Runs a job on files and writes each output to ``<output_dir>/<name>``.

    Models with several readers are persisted while the outputs are written.
    """
    if fmt not in ("csv", "json"):
        raise ValueError("fmt must be csv or json")
    built = build_models(job, bind_sources(spark, job, paths, strict))
    shared = [built[n].persist(StorageLevel.MEMORY_AND_DISK) for n in shared_models(job, built)]
    written = {}
    try:
        for name in job["outputs"]:
            written[name] = f"{output_dir.rstrip('/')}/{name}"
            (files.write_csv if fmt == "csv" else files.write_json)(built[name], written[name], mode=mode)
    finally:
        for df in shared:
            df.unpersist()
    return written
