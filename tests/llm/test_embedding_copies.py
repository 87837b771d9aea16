import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import embedding_copies as ec

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    usable = lambda v, y: y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    vectors = [np.array(v, np.float32).astype(float) if usable(v, y) else None for _, v, y in rows]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if (a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())) >= least:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((d, links[i], component, d == component))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clustered(seed, clusters, members, dim, noise):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for m in range(members if c else 4 * members):
            v = centre + rng.normal(size=dim) * noise / np.sqrt(dim)
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 3)))
    return rows


@pytest.mark.parametrize("block", [ec.BLOCK, 16])
def test_clusters_against_brute_force(spark, block):
    rows = clustered(3, 25, 8, 32, 0.12)
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {r[0]: r for r in brute(rows)}
    found = {r[0]: r for r in got(ec.embedding_copies(d, block=block))}
    assert found.keys() == want.keys() and all(found[k][1] <= want[k][1] for k in want)
    true, kept = sum(r[1] for r in want.values()), sum(r[1] for r in found.values())
    assert true > 500 and kept >= 0.97 * true
    if block == 16:  # blocks change nothing
        assert found == {r[0]: r for r in got(ec.embedding_copies(d))}


def test_links_within_five_bits_are_never_missed(spark):
    """Short codes: with fewer bits than chunks every pair meets, so the result is exact."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)], i % 2) for i in range(160)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert got(ec.embedding_copies(d, block=20)) == brute(rows)


def test_awkward_rows(spark, empty):
    v, w = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    rows = [(5, v, 1), (3, v, 1), (3, v, 1), (9, [2.0, 4.0, 6.0], 1), (4, v, 2), (None, w, 2), (None, w, 2), (8, v, None), (2, None, 1)]
    rows += [(10, [0.0, 0.0, 0.0], 1), (11, [], 1), (12, [None, 1.0, 1.0], 1), (13, [float("nan"), 1.0, 1.0], 1), (14, [float("inf"), 1.0, 1.0], 1)]
    rows += [(15, [1e38, 2e38, 3e38], 1), (16, [1e-45, 0.0, 0.0], 3), (17, [1.0, 0.0, -0.0], 3), (18, [1.0, 0.0, 0.0], 3), (19, [1.0, 0.0], 3), (None, [9.0], 9)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(ec.embedding_copies(d)) == brute(rows)
    clash = d.withColumns({n: F.lit("x") for n in ("id", "v", "t", "key", "i", "j", "code", "block", "copies", "least", "links", "component", "dim", "kept", "n_links")})
    assert got(ec.embedding_copies(clash)) == brute(rows)
    assert ec.embedding_copies(d.limit(0)).count() == 0


def test_cosines_at_the_threshold():
    a = np.array([[1.0, 0.0]])
    edge = np.array([[0.98, math.sqrt(1 - 0.98**2)], [0.98 - 1e-12, math.sqrt(1 - 0.98**2)]])
    plain = [x[0] / math.sqrt((x * x).sum()) >= 0.98 for x in edge]
    assert ec.cosines(a, edge, 0.98).tolist() == [plain]


def test_rotation_is_one_and_balances_codes():
    rng = np.random.default_rng(2)
    sample = ec.unit(rng.normal(size=(3000, 16)) * np.linspace(1, 3, 16))
    mean, p = ec.rotation(sample)
    assert np.allclose(p.T @ p, np.eye(16))
    bits = (sample - mean) @ p >= 0
    assert (np.abs(bits.mean(0) - 0.5) < 0.1).all()
    loss = lambda q: ((np.where((sample - mean) @ q >= 0, 1, -1) - (sample - mean) @ q * 4) ** 2).sum()
    assert loss(p) <= loss(np.linalg.qr(rng.normal(size=(16, 16)))[0])
    masks = ec.chunk_masks(64)
    assert sum(masks) == (1 << 64) - 1 and all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])


def test_recall_on_generated_vectors(spark):
    """64 components with cosines from the threshold on: at least nine of ten links are found."""
    rows = clustered(9, 60, 6, 64, 0.14)
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, found = {r[0]: r for r in brute(rows)}, {r[0]: r for r in got(ec.embedding_copies(d))}
    true = sum(r[1] for r in want.values())
    assert true > 300 and sum(r[1] for r in found.values()) >= 0.9 * true and all(found[k][1] <= want[k][1] for k in want)
