"""Packing of token sequences by patterns and non-negative least squares (Krell et al., 2021).

1. Texts are tokenized where they lie and cut into pieces of at most ``size`` tokens. A
   piece knows its task and its number among the task's pieces of equal length.
2. The histogram of lengths (at most ``size`` rows, whatever the corpus) goes to the
   driver. All patterns of up to three pieces that fill a sequence exactly are
   enumerated, repeat counts are fitted to the histogram by non-negative least
   squares and rounded down to what there is; the residual histogram is packed by
   best fit, longest pieces first, all pieces of a length in one step.
3. The plan is a list of intervals: pieces number a to b of length L go to the
   sequences from s on. It is broadcast (some thousand rows) and each piece looks
   its place up by its number among all pieces of its length, which is its number in
   the task plus the count of the earlier tasks. No texts or ids are shuffled.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lists, map_texts, stage

SIZE, END = 1024, 2
SPECIAL = "<|endoftext|>"
ROUNDS, BLOCK = 24, 64
RANK_BITS = 40


class Tokenizer:
    """Ids of the byte-level BPE as library ``tokenizers`` gives them.

    The same vocabulary is also installed as ranks for ``tiktoken``, which is four times
    as fast and gives the same ids for ordinary text. Texts with the special token's
    name, and any that it can't handle, go through ``tokenizers`` itself.
    """

    _loaded: dict[str, Tokenizer] = {}

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = None

    @classmethod
    def load(cls, name: str) -> Tokenizer:
        if name not in cls._loaded:
            cls._loaded[name] = cls(name)
        return cls._loaded[name]

    def encode_exact(self, text: str) -> list[int]:
        import tokenizers

        self.exact = self.exact or tokenizers.Tokenizer.from_file(self.path)
        return self.exact.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if SPECIAL in text:
            return self.encode_exact(text)
        try:
            return self.fast.encode_ordinary(text)
        except Exception:  # noqa: BLE001  its regex engine gives up on some very long runs
            return self.encode_exact(text)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all are full but the first."""
    first = (n - 1) % size + 1
    return [(0, first), *[(s, size) for s in range(first, n, size)]]


def _pieces(batches_, name: str, size: int, keep_ids: bool):
    tokenizer, part, seen = Tokenizer.load(name), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * keep_ids]
    for batch in batches_:
        owner, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = np.array([*tokenizer.encode(text or ""), END], "<u4")
            for k, (s, n) in enumerate(cut(len(own), size)):
                owner.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(own[s : s + n].tobytes()))
                if keep_ids:
                    ids.append(own[s : s + n])
        size_of = np.array(length, np.int64)
        order = np.argsort(size_of, kind="stable")
        group = np.searchsorted(size_of[order], size_of[order])  # first of the same length
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - group
        rank += seen[size_of]
        seen += np.bincount(size_of, minlength=size + 1)
        columns = [
            batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
            pa.array(crc, pa.int64()), pa.array(np.full(len(rank), part), pa.int32()), pa.array(rank),
        ]
        if keep_ids:
            columns.append(lists(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32), length, pa.int32()))
        yield pa.RecordBatch.from_arrays(columns, names)


def patterns(size: int, present: np.ndarray) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, b > 0, that sum to ``size`` and whose lengths occur; c is 0 for pairs."""
    out = []
    for c in range(size // 3 + 1):
        if c and not present[c]:
            continue
        b = np.arange(max(c, 1), (size - c) // 2 + 1)
        a = size - c - b
        b = b[present[b] & present[a]]
        out.append(np.stack([size - c - b, b, np.full(len(b), c)], 1))
    return np.concatenate(out)


def fit(histogram: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring their pieces near the histogram: active-set least squares.

    Residuals weigh as the tokens of a length, since short pieces are easy to place later.
    Like Lawson and Hanson's method, but up to `BLOCK` patterns of disjoint lengths enter in
    one round and all that turn negative leave together.
    """
    goal, weight = histogram.astype(float), np.arange(len(histogram), dtype=float)
    x, chosen = np.zeros(len(rows)), np.zeros(0, int)
    for _ in range(rounds):
        made = np.bincount(rows[chosen].ravel(), np.repeat(x[chosen], 3), len(goal))
        rest = weight * weight * (goal - made)  # 0 at length 0
        gain = rest[rows].sum(1)
        gain[chosen] = 0
        enter, used = [], np.zeros(len(goal), bool)
        for p in np.argsort(-gain, kind="stable")[: 40 * BLOCK]:
            if gain[p] <= 0.25 * weight[-1] ** 2 or len(enter) == BLOCK:
                break
            own = rows[p][rows[p] > 0]
            if not used[own].any():
                used[own] = True
                enter.append(p)
        if not enter:
            break
        chosen = np.concatenate([chosen, np.array(enter)])
        for _ in range(4):
            matrix = np.zeros((len(chosen), len(goal)))
            np.add.at(matrix, (np.arange(len(chosen))[:, None], rows[chosen]), 1)
            matrix *= weight / weight[-1]
            gram = matrix @ matrix.T + 1e-6 * np.eye(len(chosen))
            z = np.linalg.solve(gram, matrix @ (goal * weight / weight[-1]))
            x[chosen] = np.maximum(z, 0)
            if (z > 0).all():
                break
            chosen = chosen[z > 0]
    return x


class Plan:
    """Intervals of pieces, by length and number, with the sequences they go to."""

    def __init__(self, histogram: np.ndarray, size: int):
        self.size, self.left, self.sequences = size, histogram.astype(np.int64).copy(), 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first number, pieces in a sequence, first sequence, offset
        self.taken = np.zeros(size + 1, np.int64)
        if self.left[size]:
            self._put(size, int(self.left[size]), 1, self._open(int(self.left[size])), 0)
        self._patterns()
        self._best_fit()
        table = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        self.key = (table[:, 0] << RANK_BITS) + table[:, 1]
        self.table = table

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, length: int, sequences: int, each: int, base: int, offset: int) -> None:
        self.rows.append((length, int(self.taken[length]), each, base, offset))
        self.taken[length] += sequences * each
        self.left[length] -= sequences * each

    def _patterns(self) -> None:
        rows = patterns(self.size, self.left > 0)
        if not len(rows):
            return
        x = fit(self.left, rows)
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 1:
                break
            lengths, counts = np.unique(rows[p][rows[p] > 0], return_counts=True)
            n = int(min(np.floor(x[p]), *(self.left[lengths] // counts)))
            if n > 0:
                base, offset = self._open(n), 0
                for length, each in zip(lengths.tolist(), counts.tolist()):
                    self._put(length, n, each, base, offset)
                    offset += length * each

    def _best_fit(self) -> None:
        """Each length from the longest: into the sequences with the least room that suffices."""
        room: dict[int, list[tuple[int, int]]] = {}  # room -> (sequences, first sequence)
        for length in range(self.size, 0, -1):
            while n := int(self.left[length]):
                best = min((r for r in room if r >= length), default=None)
                if best is None:
                    best = self.size
                    whole = max(1, n // (best // length))
                    room[best] = [(whole, self._open(whole))]
                count, base = room[best].pop()
                each = min(best // length, n)
                full = min(count, n // each)
                self._put(length, full, each, base, self.size - best)
                if full < count:
                    room[best].append((count - full, base + full))
                if not room[best]:
                    del room[best]
                if rest := best - length * each:
                    room.setdefault(rest, []).append((full, base))

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table[np.searchsorted(self.key, (length << RANK_BITS) + number, side="right") - 1]
        along = number - row[:, 1]
        return row[:, 3] + along // row[:, 2], row[:, 4] + length * (along % row[:, 2])


def _placed(batch: pa.RecordBatch, plan) -> pa.RecordBatch:
    at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    sequence, offset = plan.value.places(at["length"].to_numpy(), at["number"].to_numpy())
    names = [n for n in batch.schema.names if n != "number"]
    return pa.RecordBatch.from_arrays([*[at[n] for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of every document.

    A document is its token ids and the id 2; a null or empty text is that id alone. Only
    longer ones are cut, into ``size`` tokens but for the first piece. Pieces of a sequence lie at
    offsets from 0 without gaps; sequence numbers have no gaps either. Repeated rows are
    packed as often as they occur; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_pieces, name=tokenizer, size=size, keep_ids=keep_ids), schema)
    rows = stage(rows)
    counts = stage(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        histogram[r[0]] = r[1]
    plan = spark.sparkContext.broadcast(Plan(histogram, size))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = rows.join(counts, ["part", "length"]).withColumn("number", F.col("rank") + F.col("before"))
    ids = ["ids"] * keep_ids
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, "number")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return map_texts(numbered, partial(_placed, plan=plan), out)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
