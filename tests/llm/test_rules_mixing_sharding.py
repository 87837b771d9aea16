import re
from collections import Counter

import numpy as np
import pytest

from oracle import connect, difference
from pyspark.sql import functions as F

from tablewright.llm import queries
from tablewright.llm.mixing import mix, mixed_documents, targets, thresholds
from tablewright.llm.quality_rules import POLICIES, RULES, ablations, apply_policy, ledger
from tablewright.llm.sharding import lookup_table, place, shard_names

DATA = "/root/testdata/sf0.001"
CON = connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    assert difference(CON, queries.SQL[name], queries.QUERIES[name](spark, DATA)) is None


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measures(awkward, clashing):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r[0]), *r[1:]) for r in ledger(awkward).select("doc_id", *names).collect())
    assert got == sorted((str(r[0]), *brute_measures(r[1])) for r in awkward.select("doc_id", "text").collect())
    assert ledger(clashing).count() == 18


def test_policies_and_ablations(awkward, empty):
    table = ledger(awkward)
    rows = {r[0]: r[1] for r in table.select(F.struct("doc_id", "n_words"), "failures").collect()}
    for version, mask in POLICIES.items():
        kept = apply_policy(table, version).filter("kept").count()
        assert kept == sum(f & mask == 0 for f in [r[0] for r in table.select("failures").collect()])
        for r in ablations(table, version).collect():
            bit = 1 << [n for n, _ in RULES].index(r["rule"])
            failures = [x[0] for x in table.select("failures").collect()]
            assert r["failed"] == sum(bool(f & bit) for f in failures)
            assert r["failed_alone"] == sum(f & mask == bit for f in failures)
            assert r["kept_with"] == kept and r["kept_without"] == sum(f & (mask & ~bit) == 0 for f in failures)
    assert rows and ledger(empty).count() == 0
    assert {r["kept_with"] for r in ablations(ledger(empty)).collect()} == {0}


def test_targets_share_the_excess(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 100), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(rows).collect()}
    want, weight = {}, dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    size = {"a": 10, "b": 1000, "c": 500, None: 100, "d": 0}
    left, open_ = 1.5 * sum(size.values()), set(size)
    while True:  # share, stop at twice the size, share the excess again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * size[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1.5 * sum(size.values()))


def test_thresholds_are_nested_and_near(spark):
    rng = np.random.default_rng(3)
    data = [("s", int(rng.integers(0, 50)), int(rng.integers(0, 1 << 60))) for _ in range(2000)]
    rows = spark.createDataFrame(data, "source string, size long, hash long")
    total = sum(d[1] for d in data)
    budgets = [("s", str(k), float(total * k / 7)) for k in range(1, 8)]
    got = {r["name"]: r["below"] for r in thresholds(rows, spark.createDataFrame(budgets, "source string, name string, budget double")).collect()}
    assert sorted(got.values()) == [got[str(k)] for k in range(1, 8)]
    for _, name, budget in budgets:
        assert abs(sum(d[1] for d in data if d[2] < got[name]) - budget) <= 25


def test_mixing_awkward_rows(awkward, clashing, empty):
    got = mix(awkward)
    assert got.count() == 18 and got.filter("size is null or times not in (0, 1, 2)").count() == 0
    again = mix(awkward.repartition(7))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    out = mixed_documents(clashing)
    assert out.columns == clashing.columns and out.count() == got.agg(F.sum("times")).first()[0]
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_lookup_table():
    names = shard_names(7)
    table = lookup_table(names, 1009)
    assert np.ptp(np.bincount(table)) <= 1
    fewer = lookup_table(names[:-1], 1009)
    assert (table[table < 6] != fewer[table < 6]).mean() < 0.25  # few slots move besides those of the lost shard
    loads = np.bincount(lookup_table({"a": 1, "b": 3}, 1009))
    assert abs(loads[1] / loads[0] - 3) < 0.05
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        lookup_table(names, 1000)


def test_place(awkward, empty):
    placed = place(awkward, ["doc_id"], shard_names(5), 1009)
    assert placed.count() == 18 and placed.filter("shard is null").count() == 0
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    table = lookup_table(shard_names(5), 1009)
    assert all(r["shard"] == f"shard-{table[r['slot']]:05d}" for r in placed.collect())
    assert place(empty, ["doc_id"], shard_names(5), 1009).count() == 0
    with pytest.raises(ValueError):
        place(placed, ["doc_id"], shard_names(5), 1009)
