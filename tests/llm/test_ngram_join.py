import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.llm.ngram_join import Join, keep_one, ngram_components, prefix_length


def brute(rows, percent=80, n=5):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        k = min(n, max(1, len(words)))
        sets[doc_id] = frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()
    ids = sorted(sets)
    least = {i: i for i in ids}
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return {i: (len(sets[i]), least[i]) for i in ids}


def corpus(seed, size):
    """Copies with edits, shared passages, common lines and unrelated texts."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnopqrst") + str(rnd.randrange(40))
    passage, base = [word() for _ in range(25)], [word() for _ in range(60)]
    out = []
    for i in range(size):
        kind = rnd.randrange(4)
        if kind == 0:
            words = list(base)
            for _ in range(rnd.randrange(6)):
                words[rnd.randrange(len(words))] = word()
        elif kind == 1:
            words = [word() for _ in range(rnd.randrange(5, 40))] + passage
        elif kind == 2:
            words = passage[: rnd.randrange(3, 25)]
        else:
            words = [word() for _ in range(rnd.randrange(1, 60))]
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("few", [2, 32])
def test_components_are_those_of_all_pairs(spark, few):
    rows = corpus(few, 160)
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), few=few)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute(rows)


def test_awkward_rows(awkward, clashing):
    got = ngram_components(awkward).collect()
    assert len(got) == 18
    known = {r[0]: (r[1], r[2]) for r in got if r[0] is not None}
    rows = {r[0]: r[1] for r in awkward.select("doc_id", "text").collect() if r[0] is not None}
    assert known == brute(rows.items())
    assert known[3] == (21, 1) and known[6] == (0, 6) and known[7] == (0, 7) and known[10] == (1, 9)
    assert all(r[2] is None for r in got if r[0] is None)
    assert sorted(map(str, ngram_components(clashing).collect())) == sorted(map(str, got))


def test_empty(empty):
    assert ngram_components(empty).count() == 0 and keep_one(empty).count() == 0


def test_keep_one(clashing):
    kept = keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = sorted(r[0] for r in kept.filter("doc_id is not null").select("doc_id").collect())
    assert ids == [1, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15]
    assert kept.filter("doc_id is null").count() == 2


def test_prefix_length_keeps_a_common_token():
    assert [prefix_length(n, 80) for n in (1, 2, 5, 10, 11)] == [1, 1, 2, 3, 3]


def test_other_orders_and_bitmaps_only_drop_pairs_that_do_not_link(spark):
    rows = corpus(7, 80)
    join = Join(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = join.classes.select("id")
    pairs = ids.withColumnRenamed("id", "u").crossJoin(ids.withColumnRenamed("id", "v")).filter(F.col("u") < F.col("v"))
    left = join.verified(join.filtered(pairs)).count()
    assert left == join.verified(pairs).count()


def words_of(seed, n=30):
    import random

    return [f"{random.Random(seed * 1000 + k).randrange(10**6)}" for k in range(n)]


def test_no_text_is_lost_under_repeated_ids(spark):
    """Every component keeps one row, although ids repeat with unrelated texts."""
    a, b, c = (" ".join(words_of(s)) for s in (1, 2, 3))
    rows = [(5, a), (7, a), (7, b), (9, b)]
    kept = sorted(map(tuple, keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert kept == [(5, a), (7, b)]
    near = b + " tail"
    rows = [(7, a), (7, b), (7, c), (7, near), (8, near), (9, c + " end"), (7, ""), (10, ""), (None, a), (7, a), (11, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({n: F.lit("x") for n in ("set_hi", "set_lo", "component", "name")})
    kept = sorted(((r[0], r[1]) for r in keep_one(d).collect()), key=str)
    texts = [t for _, t in kept if t]
    assert {i for i, _ in kept} == {7, 10, 11, None}
    assert sorted(texts) == sorted([a, c, b if b in texts else near, a])  # the row without an id stays too
    found = {(r[0], r[1], r[2]) for r in ngram_components(d).collect()}
    assert {r[2] for r in found if r[0] in (8, 9)} == {7}
