"""Files in and out, synthetic tables, and config-driven jobs."""

import datetime as dt
import json
import warnings

import pytest
from helpers import rows, sorted_rows
from pyspark.sql import functions as F

from tablewright import jobs, sources
from tablewright import operators as op


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_types_and_headers(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿id,name,name,ok,day,zip\r\n1,"x, ""y""",b,true,2024-01-01,007\r\n\r\n2,,d,false,2024-01-02,012\r\n')
    df = sources.read_csv(spark, path)
    assert df.columns == ["id", "name", "name_2", "ok", "day", "zip"]
    assert rows(df) == [(1, 'x, "y"', "b", True, dt.date(2024, 1, 1), "007"), (2, None, "d", False, dt.date(2024, 1, 2), "012")]
    assert sources.read_csv(spark, path, infer=False).dtypes[0] == ("id", "string")
    assert sources.read_csv(spark, path, column_types={"id": "float"}).dtypes[0] == ("id", "double")


def test_csv_header_modes(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a;b\n1;2\n3;4\n")
    assert sources.detect_delimiter(spark, path) == ";"
    auto = sources.read_csv(spark, path, header="auto-generate")
    assert auto.columns == ["column_1", "column_2"] and auto.count() == 3
    manual = sources.read_csv(spark, path, header="manual", names=["x", "y"])
    assert rows(manual) == [(1, 2), (3, 4)] and manual.columns == ["x", "y"]
    assert sources.read_csv(spark, path, header="manual", names=["x", "y"], skip_first=False).count() == 3


def test_csv_ragged_and_encoding(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1\n2,3,4\n5,6\n")
    df = sources.read_csv(spark, path, keep_ragged=True)
    assert sorted_rows(df, "a", "b") == [(1, None), (2, 3), (5, 6)]
    assert sorted_rows(df, "a", "_ragged") == [(1, "1"), (2, "2,3,4"), (5, None)]
    with pytest.raises(Exception):
        sources.read_csv(spark, path, strict=True, infer=False).collect()
    latin = write(tmp_path / "b.csv", "naïve\tx\né\t1\n", "iso-8859-1")
    assert sources.read_csv(spark, latin, encoding="ISO-8859-1").columns == ["naïve", "x"]


def test_json(spark, tmp_path):
    doc = {"data": {"records": [{"id": 1, "user": {"name": "A", "at": {"x": 1}}, "tags": ["p"]}, {"id": 2, "user": {"name": "B", "at": {"x": 2}}, "tags": []}]}, "more": [{"rows": [{"k": 5}]}]}
    path = write(tmp_path / "a.json", json.dumps(doc))
    df = sources.read_json(spark, path, "data.records", flatten_nested=True, serialize=True)
    assert sorted_rows(df, "id", "user_name", "user_at_x", "tags") == [(1, "A", 1, '["p"]'), (2, "B", 2, "[]")]
    assert rows(sources.read_json(spark, path, "more.0.rows")) == [(5,)]
    top = write(tmp_path / "b.json", json.dumps([{"a": 1}, {"a": 2}]))
    assert sorted_rows(sources.read_json(spark, top)) == [(1,), (2,)]


def test_writers_round_trip(spark, tmp_path, tables):
    d = op.types(tables.events.limit(50).withColumn("bad", F.col("event_type")), {"bad": "integer"}, errors=True)
    nested = d.withColumn("pair", F.array("user_id", "event_id"))
    sources.write_csv(nested, str(tmp_path / "out"))
    back = sources.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == [*tables.events.columns, "bad", "pair"] and back.count() == 50
    assert sorted_rows(back, "event_id", "value", "props") == sorted_rows(d, "event_id", "value", "props")
    sources.write_json(nested, str(tmp_path / "json"))
    lines = [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 50 and lines[0]["bad"] is None and "bad__error" not in lines[0]


def test_generate(spark):
    spec = [
        sources.NumberSequence("n", 1, 0.5, stop=3, decimals=1), sources.DateSequence("m", "2024-01-31", 1, "months"),
        sources.DateSequence("h", "2024-01-01", 6, "hours"), sources.RandomNumber("r", 0, 10), sources.RandomBoolean("b", 1),
        sources.RandomCategory("c", ("x", "y"), (0, 1)), sources.RandomDate("d", "2024-01-01", "2024-01-03"),
    ]
    df = sources.generate(spark, spec, seed=5)
    got = rows(df.orderBy("n"))
    assert [r[0] for r in got] == [1.0, 1.5, 2.0, 2.5, 3.0]
    assert [r[1] for r in got] == [dt.date(2024, 1, 31), dt.date(2024, 3, 2), dt.date(2024, 3, 31), dt.date(2024, 5, 1), dt.date(2024, 5, 31)]
    assert got[1][2] == dt.datetime(2024, 1, 1, 6)
    assert all(0 <= r[3] < 10 and r[4] is True and r[5] == "y" and r[6] in (dt.date(2024, 1, 1), dt.date(2024, 1, 2)) for r in got)
    assert sorted_rows(df) == sorted_rows(sources.generate(spark, spec, seed=5).repartition(3))
    big = sources.generate(spark, [sources.RandomCategory("c", ("a", "b"), (1, 3))], rows=20000, seed=1)
    share = big.filter("c = 'b'").count() / 20000
    assert abs(share - 0.75) < 0.02


def test_generator_rows_and_checks(spark):
    count = sources.row_count
    assert count([sources.DateSequence("d", "2024-01-01", 1, "days", "2024-01-31")]) == 31
    assert count([sources.DateSequence("d", "2024-01-31", 1, "months", "2024-12-31")]) == 12
    assert count([sources.DateSequence("d", "2024-05-01", -1, "years", "2020-01-01")]) == 5
    assert count([sources.NumberSequence("n", 0.1, 0.1, 1)]) == 10
    for bad in (
        sources.NumberSequence("n", 1, 0), sources.NumberSequence("n", 1, 1, stop=0), sources.RandomNumber("r", 2, 2), sources.RandomBoolean("b", 2),
        sources.RandomCategory("c", ()), sources.RandomCategory("c", ("a",), (1, 2)), sources.RandomDate("d", "2024-01-02", "2024-01-01"),
        sources.DateSequence("d", "2024-01-01", 0), sources.RandomNumber("r", 0, 1, 11),
    ):
        with pytest.raises(ValueError):
            sources.generate(spark, [bad], rows=3)
    with pytest.raises(ValueError, match="row count"):
        sources.generate(spark, [sources.RandomBoolean("b")])


def job_config():
    return {
        "sources": {"orders": {"columns": [{"name": "id", "type": "integer"}, {"name": "amount", "type": "integer"}]}, "names": {}},
        "models": {
            "big": {"source": "orders", "steps": [{"filter": "amount >= 20"}, {"derive": {"twice": "amount * 2"}}]},
            "named": {"source": "big", "steps": [{"lookup": {"right": "names", "on": [["id", "id"]], "values": ["name"], "orderBy": "name"}}]},
            "total": {"source": "big", "steps": [{"aggregate": {"groupby": [], "rollup": {"total": ["sum", "twice"]}}}]},
            "unused": {"source": "orders", "steps": [{"select": ["absent"]}]},
        },
        "outputs": ["named", "total"],
    }


def test_job_on_files(spark, tmp_path):
    paths = {"orders": write(tmp_path / "o.csv", "id,amount\n1,10\n2,20\n3,30\n"), "names": write(tmp_path / "n.json", '[{"id":2,"name":"b"},{"id":2,"name":"c"}]')}
    out = jobs.run_job(spark, job_config(), paths, str(tmp_path / "out"))
    assert rows(sources.read_csv(spark, out["total"])) == [(100,)]
    assert sorted_rows(sources.read_csv(spark, out["named"])) == [(2, 20, 40, "c"), (3, 30, 60, None)]
    assert jobs.shared_models(job_config(), {"big": None, "named": None, "total": None}) == ["big"]


def test_job_checks(spark, tmp_path):
    job = job_config()
    paths = {"orders": write(tmp_path / "o.csv", "ID,amount\n1,x\n"), "names": write(tmp_path / "n.json", "[]")}
    with pytest.raises(ValueError, match="found ID.*expected integer, found string"):
        jobs.bind_sources(spark, job, paths, strict=True)
    with pytest.warns(UserWarning, match="found ID"):
        jobs.bind_sources(spark, job, paths)
    with pytest.raises(ValueError, match="no file is bound"):
        jobs.bind_sources(spark, job, {})
    for change, message in (
        ({"outputs": ["none"]}, "not a model"), ({"outputs": []}, "no outputs"), ({"models": {"a": {"source": "zzz"}}, "outputs": ["a"]}, "unknown table zzz"),
        ({"models": {"a": {"source": "b"}, "b": {"source": "a"}}, "outputs": ["a"]}, "depend on each other"),
    ):
        with pytest.raises(ValueError, match=message):
            jobs.build_models({**job, **change}, {"orders": spark.range(1), "names": spark.range(1)})


def test_every_step(spark):
    d = spark.createDataFrame([(1, "a-b", 1.0, "x"), (2, "c", None, "x"), (3, "d-e-f", 3.0, "y")], "id int, s string, v double, g string")
    tables = {"other": spark.createDataFrame([(1, "one"), (3, "three")], "id int, label string")}
    steps = {
        "select": ["id", "v"], "remove": ["s"], "rename": {"s": "t"}, "selectPattern": {"pattern": "s", "matchType": "prefix"},
        "removePattern": {"pattern": "s", "matchType": "prefix"}, "renamePattern": {"find": "s", "replace": "z"}, "derive": {"w": "v + 1"},
        "conditional": {"column": "c", "conditions": [{"when": "v > 2", "then": "'hi'"}], "else": "'lo'"}, "filter": "v > 1",
        "replace": {"column": "g", "find": "x", "replace": "z"}, "sort": {"field": "v", "order": "desc"},
        "sliceRows": {"count": 1, "mode": "last", "orderBy": "id"}, "addIndex": {"columnName": "i", "orderBy": "id"}, "dedupe": {"columns": ["g"], "orderBy": "id"},
        "sample": {"count": 2, "seed": 1}, "removeRows": {"indices": [0], "orderBy": "id"}, "keepRows": {"indices": [0], "orderBy": "id"},
        "promoteHeader": {"skipRows": 0, "orderBy": "id"}, "join": {"right": "other", "on": [["id", "id"]], "how": "left"}, "semijoin": {"right": "other", "on": [["id", "id"]]},
        "antijoin": {"right": "other", "on": [["id", "id"]]}, "lookup": {"right": "other", "on": ["id"], "values": ["label"], "orderBy": "label"},
        "concat": {"with": "other"}, "union": {"with": "other"}, "aggregate": {"groupby": ["g"], "rollup": {"n": "count", "m": ["mean", "v"]}},
        "describe": {"columns": ["v", "g"]}, "window": {"orderBy": [{"field": "id"}], "partitionBy": ["g"], "derive": {"p": ["lag", "v"], "r": "row_number"}},
        "types": {"v": "integer"}, "impute": {"column": "v", "strategy": "mean"}, "fold": {"columns": ["s", "g"]}, "pivot": {"rows": ["s"], "keys": "g", "values": "v"},
        "split": {"column": "s", "delimiter": "-"}, "spread": {"column": "s"}, "unroll": {"column": "s"}, "import": {},
    }
    assert set(steps) == set(jobs.STEPS)
    want = {"filter": 1, "sliceRows": 1, "dedupe": 2, "sample": 2, "removeRows": 2, "keepRows": 1, "promoteHeader": 2, "semijoin": 2, "antijoin": 1, "concat": 5,
            "union": 5, "aggregate": 2, "fold": 6, "describe": 9}
    for name, options in steps.items():
        assert jobs.apply_step(d, {name: options}, tables).count() == want.get(name, 3), name
    errors = jobs.run_steps(d, [{"types": {"s": "integer"}}, {"replace": {"column": "s", "matchMode": "errors", "replace": 0}}, {"replace": {"column": "v", "matchMode": "null", "replace": 0}}])
    assert {r["s"] for r in errors.collect()} == {0} and errors.filter("v is null").count() == 0
    assert jobs.apply_step(d, {"replace": {"column": "s", "find": "-", "replace": "+", "isRegex": True}}).first()["s"] == "a+b"
    call = {"derive": {"r": {"fn": "round", "args": [{"fn": "divide", "args": ["id", 2]}, 0]}, "t": {"fn": "split", "args": ["s", "-", -1]}}}
    assert sorted_rows(jobs.apply_step(d, call), "r", "t") == [(1.0, "b"), (1.0, "c"), (2.0, "f")]
    with pytest.raises(ValueError, match="unknown function"):
        jobs.apply_step(d, {"filter": {"fn": "nothing"}})
    with pytest.warns(UserWarning, match="no known operator"):
        assert jobs.apply_step(d, {"frobnicate": {}}) is d
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        jobs.apply_step(d, {"filter": "true"})
