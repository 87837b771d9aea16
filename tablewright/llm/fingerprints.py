"""Document fingerprints by context-triggered piecewise hashing (Kornblum, 2006).

A rolling hash of the last seven code points ends a chunk wherever it falls on a
multiple of the block size, so that chunk borders depend on nearby text only and an edit
changes few chunks. A fingerprint is the block size and one character per chunk, for
that block size and for twice it. Two fingerprints are compared at a block size that
both have, by the edit distance of their signatures.

The block size is the smallest ``3 * 2^k`` that gives at most 64 chunks, found by counting
borders, so every code point of a text of any length is in some chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts, stage
from .kernels import mix

WINDOW, MOST, LEAST_BLOCK = 7, 64, 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_NUMBER = np.full(128, -1, np.int64)
_NUMBER[_LETTERS] = np.arange(64)
# Odd multipliers: one per place in the window, and the base of the chunk hash (fixed values).
_WEIGHTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xB5297A4D, 0x68E31DA5], np.uint64)


def rolling(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the (up to seven) code points that end at each place."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(min(WINDOW, len(codes))):
        out[k:] += (codes[: len(codes) - k] + np.uint64(1)) * _WEIGHTS[k]
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def _signature(codes: np.ndarray, ends: np.ndarray, size: int) -> str:
    """A character for each chunk; ``ends`` are the places at which chunks of some block size end."""
    if not size:
        return ""
    cuts = np.concatenate([[0], ends + 1])
    cuts = np.append(cuts, size) if cuts[-1] < size else cuts
    # The hash of a chunk sums its code points mixed with their place in the chunk.
    place = np.arange(size) - np.repeat(cuts[:-1], np.diff(cuts))
    sums = np.add.reduceat(mix((codes << np.uint64(32)) + place.astype(np.uint64)), cuts[:-1])
    return _LETTERS[(mix(sums) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """``block:signature:signature of twice the block``; an empty text has ``3::``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    hashes, block = rolling(codes), LEAST_BLOCK
    while len(codes) // (block * 4) > MOST:  # far too small, whatever the text; then count
        block *= 2
    while True:
        ends = np.flatnonzero(hashes % np.uint32(block) == 0)
        if len(ends) + 1 <= MOST:
            break
        block *= 2
    while block > LEAST_BLOCK:  # a text with few borders may have room for a smaller block
        finer = np.flatnonzero(hashes % np.uint32(block // 2) == 0)
        if len(finer) + 1 > MOST:
            break
        block, ends = block // 2, finer
    twice = ends[hashes[ends] % np.uint32(2 * block) == 0]
    return f"{block}:{_signature(codes, ends, len(codes))}:{_signature(codes, twice, len(codes))}"


def common_subsequence(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of signatures (at most 64 characters), bit-parallel.

    One 64-bit word per pair holds a row of the dynamic program (Hyyrö, 2004).
    """
    n = len(left)
    a_size, b_size = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    matches = np.zeros((n, 64), np.uint64)
    rows = np.repeat(np.arange(n), a_size)
    where = np.arange(len(rows)) - np.repeat(np.cumsum(a_size) - a_size, a_size)
    letters = _NUMBER[np.frombuffer("".join(left).encode(), np.uint8)]
    np.bitwise_or.at(matches, (rows, letters), np.uint64(1) << where.astype(np.uint64))
    other = np.full((n, max(1, int(b_size.max(initial=0)))), -1)
    other[np.arange(other.shape[1]) < b_size[:, None]] = _NUMBER[np.frombuffer("".join(right).encode(), np.uint8)]
    row = np.full(n, 2**64 - 1, np.uint64)
    for k in range(other.shape[1]):
        live = other[:, k] >= 0
        m = np.where(live, matches[np.arange(n), np.maximum(other[:, k], 0)], 0)
        u = row & m
        row = np.where(live, (row + u) | (row - u), row)
    used = np.where(a_size == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(a_size, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~row & used).astype(np.int64)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """How alike fingerprints are, pair by pair: 1 for equal ones, 0 if no block size is common.

    ``1 - d / (m + n)`` with the edit distance d (insertions and deletions; a change is both)
    of signatures of lengths m and n; the best of the block sizes in common.
    """
    parts = [[f.split(":") for f in side] for side in (left, right)]
    best = np.zeros(len(left))
    for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
        at = [i for i, (a, b) in enumerate(zip(*parts)) if int(a[0]) << x == int(b[0]) << y]
        if at:
            a, b = [parts[0][i][1 + x] for i in at], [parts[1][i][1 + y] for i in at]
            total = np.array([len(p) + len(q) for p, q in zip(a, b)])
            value = np.where(total > 0, 2 * common_subsequence(a, b) / np.maximum(total, 1), 1.0)
            best[at] = np.maximum(best[at], value)
    equal = np.array([a == b for a, b in zip(left, right)], bool)
    return np.where(equal, 1.0, best)


def edited(text: str, following: str) -> str:
    """The last half of the text, rounded down, replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids, texts, following, prints, next_prints):
    changed = [edited(t, f) for t, f in zip(texts, following)]
    changed_prints = [fingerprint(t) for t in changed]
    digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digest, pa.string()), pa.array(prints, pa.string()),
            pa.array(changed_prints, pa.string()), pa.array(likeness(prints, changed_prints)), pa.array(likeness(prints, next_prints)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(found):
    """Results of all documents of a sorted partition but the last one; the first and the last are passed on with their texts."""
    part, first, last = TaskContext.get().partitionId(), None, None

    def with_edges(rows, edges):
        n, m = rows.num_rows if rows else 0, len(edges)
        names = [f.split()[0] for f in _OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = [pa.chunked_array(([rows.column(k)] if rows else []) + [pa.nulls(m, t)]).combine_chunks() for k, t in enumerate(types)]
        extra = [pa.array([None] * n + [e[k] for e in edges], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *extra, pa.array([part] * (n + m), pa.int32())], [*names, "edge", "edge_id", "edge_text", "part"])

    for batch in found:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        if not ids:
            continue
        if first is None:
            first = (ids[0], texts[0])
        prints = [fingerprint(t) for t in texts]
        if last is not None:
            ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
        last = (ids[-1], texts[-1], prints[-1])
        if len(ids) > 1:
            yield with_edges(_rows(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:]), [])
    if last is not None:
        yield with_edges(None, [("first", *first), ("last", *last[:2])])


def _at_edges(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, texts, following = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
    return _rows(ids, texts, following, [fingerprint(t) for t in texts], [fingerprint(t) for t in following])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is the one with the next larger id, after the last the first; a sole
    document is its own next. Null ids come first; rows of equal ids are ordered by text. A
    null text counts as empty. An empty table gives no rows.

    Texts are range partitioned by id once and read in order. Only the two rows at the
    edges of each partition meet those of other partitions, by a second, small step.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    done = stage(ordered.mapInArrow(_in_order, f"{_OUT}, edge string, edge_id long, edge_text string, part int"))
    edges = done.filter("edge is not null").select("part", "edge", F.col("edge_id").alias("doc_id"), F.col("edge_text").alias("text"))
    # Only partition numbers are put in order here, not texts.
    order = Window.orderBy("part")
    parts = edges.select("part").distinct().select("part", F.lead("part").over(order).alias("then"), F.min("part").over(Window.partitionBy()).alias("least"))
    parts = parts.select("part", F.coalesce("then", "least").alias("then"))
    firsts = edges.filter("edge = 'first'").select(F.col("part").alias("then"), F.col("text").alias("following"))
    pairs = edges.filter("edge = 'last'").join(parts, "part").join(firsts, "then").select("doc_id", "text", "following")
    return done.filter("edge is null").select(*[f.split()[0] for f in _OUT.split(", ")]).unionByName(map_texts(pairs, _at_edges, _OUT))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
