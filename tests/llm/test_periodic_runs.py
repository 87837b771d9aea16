import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import periodic_runs as pr

from .conftest import awkward_rows


def brute(s):
    """All runs by trying every period at every place."""
    n, found = len(s), {}
    for q in range(1, n // 4 + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and s[i] == s[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i + q - start >= max(6, 4 * q):
                    found.setdefault((start, i + q), q)  # periods rise: the smallest comes first
                start = None
    return sorted((a, b, q) for (a, b), q in found.items())


def found(s):
    return [tuple(r) for r in pr.runs(np.array([hash(x) & 0xFFFFFFFF for x in s], np.uint64)).tolist()] if len(s) else []


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_binary_strings(s):
    assert sorted(found(s)) == brute(s)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9)), max_size=6))
def test_repeated_blocks(parts):
    s = [x for block, times in parts for x in block * times]
    assert sorted(found(s)) == brute(s)


@pytest.mark.parametrize("period", [1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 32, 33, 64, 100])
@pytest.mark.parametrize("tail", [-1, 0, 1])
def test_every_scale_at_the_least_length(period, tail):
    rng = np.random.default_rng(period)
    block = rng.integers(0, 50, period).tolist()
    stretch = (block * 5)[: max(6, 4 * period) + tail]
    s = [900, 901, *stretch, 902]
    assert sorted(found(s)) == brute(s)
    assert sorted(found([*s, *s])) == brute([*s, *s])


def test_nested_periods():
    inner = [1, 1, 1, 1, 1, 1, 1, 2]
    s = [9, *inner * 6, 8, *([*inner * 2, 3] * 5), 7, *[4] * 40]
    assert sorted(found(s)) == brute(s)
    fibonacci, other = "a", "ab"
    while len(other) < 400:
        fibonacci, other = other, other + fibonacci
    assert sorted(found(other)) == brute(other)


def test_texts_of_a_batch_stay_apart():
    texts = [[1] * 5, [1] * 5, [], [2, 3] * 4, [2, 3] * 3]
    first = np.cumsum([0, *map(len, texts)])
    flat = np.array(list(itertools.chain(*texts)), np.uint64)
    assert [[tuple(x) for x in r.tolist()] for r in pr.batch_runs(flat, first)] == [brute(t) for t in texts]


def expected(doc_id, text, edit):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if edit and doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    rows = sorted((a, b - a, q) for a, b, q in brute(w))
    rows.sort(key=lambda r: (r[0], r[2]))
    drop = {i for a, z, q in rows for i in range(a + q, a + z)}
    best = min(rows, key=lambda r: (-r[1], r[0], r[2])) if rows else None
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(rows), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{a},{z},{q}\n" for a, z, q in rows)), digest(" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


def test_awkward_rows(awkward, clashing, empty):
    texts = sorted((str(r[0]), str(r[1])) for r in awkward_rows() if r[0] not in (11, 12))
    for edit in (False, True):
        got = [r for r in pr.periodic_runs(clashing, edit).collect() if r["doc_id"] not in (11, 12)]
        assert len(got) == len(texts)
        want = sorted(str((r[0], *expected(r[0], r[1], edit))) for r in awkward_rows() if r[0] not in (11, 12))
        columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
        assert sorted(str(tuple(r[c] for c in columns)) for r in got) == want
    assert pr.periodic_runs(empty).count() == 0 and pr.periodic_runs(awkward).count() == len(awkward_rows())


def test_collapsed_text(spark):
    d = spark.createDataFrame([(1, "go " * 9 + "home x y x y x y x y x y. end")], "doc_id long, text string")
    r = pr.periodic_runs(d).first()
    assert r["collapsed"] == "go home x y y. end" and r["runs"] == [0, 9, 1, 10, 9, 2] and r["n_words"] == 21


def test_query_on_whole_small_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect() if len(r[1] or "") < 12_000}
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    seen = 0
    for r in pr.op13_periodic_runs(spark, folder).collect():
        if r["doc_id"] in texts:
            assert tuple(r[c] for c in columns) == expected(r["doc_id"], texts[r["doc_id"]], True)
            seen += 1
    assert seen == len(texts) > 100
