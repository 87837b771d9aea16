import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Reference

from tablewright.llm.packing import Plan, Tokenizer, cut, pack, patterns

REFERENCE = Reference.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_plan(histogram, size):
    plan = Plan(histogram, size)
    length = np.repeat(np.arange(size + 1), histogram)
    number = np.concatenate([np.arange(n) for n in histogram])
    sequence, offset = plan.places(length, number)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    first = np.append(True, np.diff(sequence) > 0)
    assert (offset[first] == 0).all() and (offset[1:][~first[1:]] == (offset + length)[:-1][~first[1:]]).all()
    assert (offset + length).max(initial=0) <= size and len(np.unique(sequence)) == plan.sequences
    return plan.sequences, -(-int((histogram * np.arange(size + 1)).sum()) // size)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_every_piece_has_its_own_place(lengths):
    check_plan(np.bincount(np.array(lengths, int), minlength=65), 64)


@pytest.mark.parametrize("seed", range(3))
def test_few_sequences(seed):
    lengths = np.clip(np.random.default_rng(seed).lognormal(5.5, 1, 20_000).astype(int), 1, 1024)
    used, least = check_plan(np.bincount(lengths, minlength=1025), 1024)
    assert used <= 1.002 * least


def test_patterns_are_all_partitions_into_two_or_three():
    got = {tuple(r) for r in patterns(24, np.ones(25, bool)).tolist()}
    assert got == {(a, b, 24 - a - b) for a in range(25) for b in range(1, a + 1) if 0 <= 24 - a - b <= b}


def test_cut():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(4, 4) == [(0, 4)] and cut(1, 4) == [(0, 1)] and cut(12, 4) == [(0, 4), (4, 4), (8, 4)]


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_reference_tokenizer(text):
    assert Tokenizer.load("byte_bpe_50k").encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_pack_awkward_rows(awkward, clashing, empty):
    rows = awkward.select("doc_id", "text").collect()
    out = [r.asDict() for r in pack(awkward, size=64, keep_ids=True).collect()]
    want = sorted((str(r[0]), REFERENCE.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows if r[0] not in (10, None))
    for doc_id, ids in want:
        own = sorted((r for r in out if str(r["doc_id"]) == doc_id), key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == [s for s, _ in cut(len(ids), 64)]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in own)
    assert sum(r["doc_id"] == 10 for r in out) == 2
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64
    assert pack(clashing, size=64).count() == len(out) and pack(empty).count() == 0
