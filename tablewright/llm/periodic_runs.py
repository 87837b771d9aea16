"""Periodic runs of words, found through string synchronising sets (Kempa and Kociumaka, 2019).

A run is a stretch with smallest period q and at least ``max(6, 4 q)`` words that can't be
extended. At every dyadic scale s a set of positions is chosen by hashes so that the choice
depends on the next 2 s words only (equal contexts are chosen alike), and so that every s
consecutive positions hold one unless they lie in a stretch of period at most s / 4:

    i is chosen if, among the windows of s words at i, …, i + s, the least hash is that of
    the first or of the last; windows inside a stretch of period at most s / 4 don't count

A run of period q in [s, 2 s) has a chosen position among its first s, and the position q
words on has the same next 2 s words, so it is chosen too: neighbouring chosen positions of
equal context propose all such periods. The stretches that the sets leave out are runs of
smaller periods; those are known from the scales before and, for periods below 4, from a
direct comparison. Proposals are extended both ways by comparing hashed windows of falling
sizes. All texts of a batch are treated together in numpy.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .kernels import batches, mix, words

LEAST, FOLD, DIRECT = 6, 4, 4  # least words, least periods, and the first period that is not compared directly
_TOP = np.uint64(2**64 - 1)

_SCHEMA = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<long>, collapsed string"
)


def _windows(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the windows of 1, 2, 4, … symbols at every position; windows that leave the array are shorter."""
    out, size = [mix(symbols)], 1
    while 2 * size <= longest:
        left = out[-1]
        right = np.zeros_like(left)
        right[: len(left) - size] = left[size:]
        out.append(mix(mix(left) ^ right))
        size *= 2
    return out


def _least(ids: np.ndarray, size: int) -> np.ndarray:
    """The least of ``ids[i : i + size + 1]`` at every i, with the end of the array as large values."""
    out, width = ids, 1
    while width <= size:
        step = min(width, size + 1 - width)
        moved = np.full_like(out, _TOP)
        moved[: len(out) - step] = out[step:]
        out = np.minimum(out, moved)
        width += step
    return out


def _extended(windows: list[np.ndarray], a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the widest stretch of period q around each position a with symbol a equal to symbol a + q."""
    n = len(windows[0])
    right, left = a.copy(), a.copy()
    for k in range(len(windows) - 1, -1, -1):
        size, w = 1 << k, windows[k]
        for _ in range(2 if k < len(windows) - 1 else n // size + 1):
            fits = np.flatnonzero(right + q + size <= n)
            fits = fits[w[right[fits]] == w[right[fits] + q[fits]]]
            right[fits] += size
            if not len(fits):
                break
        for _ in range(2 if k < len(windows) - 1 else n // size + 1):
            fits = np.flatnonzero(left >= size)
            fits = fits[w[left[fits] - size] == w[left[fits] - size + q[fits]]]
            left[fits] -= size
            if not len(fits):
                break
    return left, right + q


def _direct(symbols: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of period q, by comparing every symbol with the one q on."""
    same = np.concatenate([[False], symbols[:-q] == symbols[q:], [False]]) if len(symbols) > q else np.zeros(2, bool)
    edge = np.flatnonzero(np.diff(same.view(np.int8)))
    return edge[0::2], edge[1::2] + q


def _chosen(windows: list[np.ndarray], scale: int, covered: np.ndarray) -> np.ndarray:
    """The synchronising positions of one scale; windows in ``covered`` don't count."""
    ids = windows[scale.bit_length() - 1].copy()
    ids[ids == _TOP] -= np.uint64(1)
    ids[covered] = _TOP
    least = _least(ids, scale)
    last = np.full_like(ids, _TOP)
    last[: len(ids) - scale] = ids[scale:]
    return np.flatnonzero((least < _TOP) & ((ids == least) | (last == least)))


def runs(symbols: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, end, period) rows of all runs of an array of 64-bit symbols, ordered by start and period.

    ``longest`` bounds the length of a run, if it is known.
    """
    n = len(symbols)
    longest = n if longest is None else longest
    windows = _windows(symbols, max(2, longest // 2))
    found = []

    def add(start, end, period):
        """Of each stretch the smallest period counts; multiples of it have the same bounds."""
        long = end - start >= np.maximum(LEAST, FOLD * period)
        rows = np.stack([start[long], end[long], period[long]], 1)
        if found:
            rows = np.concatenate([*found, rows])
            found.clear()
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]
        found.append(rows[first])

    for q in range(1, DIRECT):
        start, end = _direct(symbols, q)
        add(start, end, np.full(len(start), q))
    scale = DIRECT
    while FOLD * scale <= longest:
        # Only what a window of `scale` symbols shows by itself, so that equal windows are treated alike.
        known = found[0][np.maximum(LEAST, FOLD * found[0][:, 2]) <= scale]
        inside = np.zeros(n + 1, np.int64)  # windows of `scale` symbols that lie in a known run
        wide = known[known[:, 1] - known[:, 0] >= scale]
        np.add.at(inside, wide[:, 0], 1)
        np.add.at(inside, wide[:, 1] - scale + 1, -1)
        at = _chosen(windows, scale, np.cumsum(inside[:-1]) > 0)
        at = at[at + 2 * scale <= n]
        context = windows[scale.bit_length()][at]
        order = np.argsort(context, kind="stable")  # positions rise within a context
        at, context = at[order], context[order]
        gap = at[1:] - at[:-1]
        pair = np.flatnonzero((context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale))
        start, period = at[:-1][pair], gap[pair]
        # Proposals of one period whose contexts meet lie in one stretch: the first speaks for them.
        order = np.lexsort((start, period))
        start, period = start[order], period[order]
        apart = np.append(True, (period[1:] != period[:-1]) | (start[1:] > start[:-1] + 2 * scale))[: len(start)]
        start, period = start[apart], period[apart]
        add(*_extended(windows, start, period), period)
        scale *= 2
    rows = found[0]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def batch_runs(symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """`runs` of each text of a batch; ``first`` has the position of the first word of each text, and the end."""
    texts = len(first) - 1
    size = np.diff(first)
    place = first[:-1] + np.arange(texts)  # a symbol of its own follows each text, so no run crosses two
    joined = np.zeros(len(symbols) + texts, np.uint64)
    ends = place + size
    inner = np.ones(len(joined), bool)
    inner[ends] = False
    joined[inner] = symbols
    joined[ends] = mix(np.arange(texts, dtype=np.uint64) ^ np.uint64(0x5EED_0F_5E7A))
    rows = runs(joined, int(size.max(initial=0))) if len(joined) else np.zeros((0, 3), np.int64)
    of = np.searchsorted(place, rows[:, 0], side="right") - 1
    bounds = np.searchsorted(of, np.arange(texts + 1))
    return [rows[a:b] - np.array([p, p, 0]) for a, b, p in zip(bounds[:-1], bounds[1:], place)]


def _period_words(doc_id, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document that the query makes periodic; None if it stays."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _report(batch: pa.RecordBatch, edit: bool, texts_too: bool):
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for begin, raws in batches(texts):
        w = words(raws)
        places = [_period_words(d, int(n)) if edit else None for d, n in zip(ids[begin : begin + len(raws)], np.diff(w.first))]
        symbols = w.hash.copy()
        for k, place in enumerate(places):
            if place is not None:
                symbols[w.first[k] : w.first[k + 1]] = w.hash[w.first[k] + place]
        out = []
        for raw, place, own in zip(raws, places, batch_runs(symbols, w.first)):
            tokens = raw.split()  # bytes are split at just these six characters
            n = len(tokens)
            if place is not None:
                tokens = [tokens[i] for i in place.tolist()]
            length = own[:, 1] - own[:, 0]
            if len(own):
                drop = np.zeros(n + 1, np.int64)
                np.add.at(drop, own[:, 0] + own[:, 2], 1)
                np.add.at(drop, own[:, 1], -1)
                keep = np.cumsum(drop[:-1]) == 0
                tokens = [t for t, k in zip(tokens, keep.tolist()) if k]
                best = int(np.lexsort((own[:, 2], own[:, 0], -length))[0])
                longest = [int(own[best, 0]), int(length[best]), int(own[best, 2]), int(1000 * length[best] // own[best, 2])]
            else:
                longest = [None] * 4
            listed = np.stack([own[:, 0], length, own[:, 2]], 1)
            spelt = "".join(f"{s},{z},{q}\n" for s, z, q in listed.tolist())
            collapsed = b" ".join(tokens)
            row = [n, len(own), *longest, hashlib.sha256(spelt.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()]
            out.append([*row, listed.ravel().tolist() if texts_too else None, collapsed.decode("utf-8", "surrogatepass") if texts_too else None])
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.int64()), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(raws)), *columns], ["doc_id", *[p.split()[0] for p in _SCHEMA.split(", ")]])


def periodic_runs(docs: DataFrame, edit: bool = False, texts_too: bool = True) -> DataFrame:
    """Runs of every text: their number, the longest, digests, and with ``texts_too`` the runs and the collapsed text.

    Needs ``doc_id`` and ``text``; other columns don't matter, whatever their names.
    ``runs`` lists start, length and period of each run one after the other, by start, then
    period. ``collapsed`` is the text with one space between words and without the words
    that some run contains after its first period. Null, empty and wordless texts have no
    words and no runs: the digests are those of the empty text. Rows are treated one by one,
    so repeated rows and ids give repeated results, and an empty table none. Texts of
    any length are read whole. Words are compared by 64-bit hashes. ``edit`` first makes
    every tenth document (by a hash of its id) periodic from some word on; rows without an id stay.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = map_texts(rows, partial(_report, edit=edit, texts_too=texts_too), f"doc_id long, {_SCHEMA}")
    return out if texts_too else out.drop("runs", "collapsed")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=True, texts_too=False).drop("n_words")
