import math

import duckdb
import numpy as np
import pytest

from tablewright.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives=10):
    """Plain Python over lists of (id, vector, label)."""
    known = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in known:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in known if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("slab, leaf", [(hn.SLAB, hn.LEAF), (90, 8), (7, 3)])
def test_against_brute_force(spark, slab, leaf):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] * 0.3 + rng.normal(size=8) * 0.2], int(rng.integers(0, 6)) if i % 5 else 3) for i in range(400)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 20)
    assert got(hn.hard_negatives(d, every=20, slab=slab, leaf=leaf)) == want and len(want) > 200


def test_awkward_rows(spark):
    v = [0.5, -0.25, 0.125]
    rows = [(100 * k, v, 1) for k in range(4)] + [(100, v, 1), (100, v, 2), (200, [0.1, 0.2, 0.3], 4)]
    rows += [(5, v, 2), (6, v, 2), (8, [0.25, -0.1, 0.1], 2), (9, [0.25, -0.1, 0.1], 3), (9, [0.25, -0.1, 0.1], 3)]
    rows += [(10, [], 1), (400, [], 1), (11, [], 2), (12, [1.0], 2), (500, [1.0], 2), (13, [-1.0], 2), (14, [0.5], 3)]
    rows += [(None, v, 1), (15, None, 1), (16, v, None), (17, [None, 1.0, 1.0], 1), (18, [float("nan"), 1.0, 1.0], 1), (19, [float("inf"), 1.0, 1.0], 1)]
    rows += [(600, [3e38, 3e38], 5), (20, [3e38, 2e38], 5), (22, [1e38, 1e38], 6), (23, [1e-38, 1e-38], 6)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(2)
    want = [tuple(max(-hn.MOST, min(hn.MOST, x)) for x in r) for r in brute(rows)]
    assert [r for r in got(hn.hard_negatives(d)) if r[0] != 600] == [r for r in want if r[0] != 600]
    from pyspark.sql import functions as F

    names = ("id", "a", "v", "dim", "row", "tree", "part", "slot", "score", "rank", "spans", "values", "own", "group", "ids", "labels")
    assert got(hn.hard_negatives(d.withColumns({n: F.lit("x") for n in names}), slab=5, leaf=2)) == got(hn.hard_negatives(d))
    assert got(hn.hard_negatives(spark.createDataFrame([], SCHEMA))) == []


def test_products_beyond_doubles():
    a, b = np.array([[2.0**40, 3.0, -1.0]]), np.array([[2.0**20, 1.0, 1.0], [2.0**80, 0.0, 0.0]])
    assert hn.products(a, b).tolist() == [[2**60 + 2, hn.MOST]]


def test_boxes_are_pruned():
    """Clustered vectors: most leaves are never opened, and the finds are those of a full scan."""
    rng = np.random.default_rng(1)
    centres = np.array([(x, y, 1 - x) for x in range(4) for y in range(4)], float)
    values = np.floor(256 * (np.repeat(centres, 200, 0) + rng.normal(size=(3200, 3)) * 0.02))
    ids, labels = np.arange(3200), np.repeat(np.arange(16), 200)
    leaves = [(ids[r].astype(np.int64).tobytes(), labels[r].astype(np.int64).tobytes(), hn._narrow(values[r])) for r in hn.tiles(values, 32)]
    assert sorted(np.concatenate(hn.tiles(values, 32)).tolist()) == ids.tolist() and max(len(r) for r in hn.tiles(values, 32)) <= 32
    tree = hn.Tree(3, leaves)
    ask = values[[0, 1, 2]]
    low, high = np.array([60_000, -hn.MOST, 0]), np.array([70_000, hn.MOST, 500])
    assert len(leaves) >= 100
    slot, found, score = tree.search(ask, labels[[0, 1, 2]], ids[[0, 1, 2]], np.arange(3), low, high, 4, False)
    full = hn.products(ask, values)
    for s in range(3):
        fits = sorted((-int(full[s, j]), j) for j in range(3200) if labels[j] != labels[s] and low[s] <= full[s, j] <= high[s])[:4]
        assert [(-int(c), int(j)) for j, c in zip(found[slot == s], score[slot == s])] == fits
    same = tree.search(ask, labels[[0, 1, 2]], ids[[0, 1, 2]], np.arange(3), np.full(3, -hn.MOST), np.full(3, hn.MOST), 4, True)
    assert len(same[0]) == 12 and tree.opened < len(leaves) / 4


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.sql(f"create view embeddings as from '{folder}/embeddings.parquet'")
        want = sorted(db.sql(hn.OP11_SQL).fetchall())
    assert got(hn.op11_hard_negatives(spark, folder)) == want and len(want) > 100
