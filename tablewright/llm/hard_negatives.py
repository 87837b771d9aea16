"""Hard negatives by an STR-packed R-tree over integer vectors.

*Packing.* Rows are range partitioned by label, first component and a row number, so that one frequent
label or vector spreads over many tasks. Of each run of at most `SLAB` rows numpy makes a tree by sort-tile
recursion: slices by the component of widest spread, each of them sliced by its own widest one, and so
on down to leaves of at most `LEAF` rows. A leaf is one row of a table that is written once.

*Search.* A task reads the leaves of a tree and then anchors. Over a box [lo, hi] the inner product with
an anchor a lies between the sums over the components of min(a lo, a hi) and of max(a lo, a hi). Boxes wait
in a queue, the best upper limit first. A box is opened only for those anchors whose score window it
meets and whose k-th best so far isn't strictly above its upper limit. The (at most k) finds of a
tree for an anchor's window meet those of the other trees in a rank window.

Positives are searched in the trees that hold the anchor's label, negatives in all trees. The anchors are
a stated share of the rows and meet the trees in blocks.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stage

SLAB, LEAF, FAN = 32_768, 256, 16  # rows of a tree, rows of a leaf, boxes below a box
BLOCK = 256  # anchors searched together
EXACT = float(1 << 53)  # integer sums below this are exact in doubles
MOST = (1 << 63) - 1  # scores beyond it count as this

_LEAF = "tree long, dim int, own array<long>, ids binary, labels binary, values binary"
_FOUND = "a long, slot int, id long, score long"


# Vectors --------------------------------------------------------------------


def taking_part(rows: DataFrame) -> DataFrame:
    """(id, label, dim, v) of the rows that take part; labels of ids divisible by 7 move on by one."""
    label, v = F.col("label").cast("long"), F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    known = F.col("vec_id").isNotNull() & label.isNotNull() & v.isNotNull()
    return rows.filter(known & finite).select(F.col("vec_id").cast("long").alias("id"), moved.alias("label"), F.size(v).alias("dim"), v.alias("v"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy() if rows else np.zeros(0)
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(256.0 * flat.astype(float))).reshape(rows, -1)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in two bytes each if they fit, else as doubles."""
    return values.astype(np.int16 if not values.size or np.abs(values).max() < 1 << 15 else np.float64).tobytes()


def _wide(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = np.int16 if len(raw) == 2 * rows * dim else np.float64
    return np.frombuffer(raw, kind).astype(np.float64).reshape(rows, dim)


# Packing --------------------------------------------------------------------


def tiles(values: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf, by sort-tile recursion: with n components, slices by the n-th root of the leaves still to make.

    Beyond log2(leaves) components that root is 2, so that many of the widest are used.
    """
    depth = min(values.shape[1], int(np.ceil(np.log2(max(2, -(-len(values) // leaf))))))

    def cut(rows: np.ndarray, left: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or not values.shape[1]:
            return [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
        own = values[rows]
        with np.errstate(over="ignore"):
            widest = int(np.argmax(own.max(0) - own.min(0)))
        rows = rows[np.argsort(own[:, widest], kind="stable")]
        slices = leaves if left == 1 else int(np.ceil(leaves ** (1 / left)))
        size = -(-leaves // slices) * leaf
        return [x for i in range(0, len(rows), size) for x in (cut(rows[i : i + size], left - 1) if left > 1 else [rows[i : i + size]])]

    return cut(np.arange(len(values)), depth)


def _packed(found, slab: int, leaf: int):
    """Leaves of the trees of one sorted partition; a tree has one dimension and at most ``slab`` rows."""
    part, trees, held = TaskContext.get().partitionId(), 0, []

    def emit():
        nonlocal trees, held
        if held:
            ids, labels, values = (np.concatenate(c) for c in zip(*held))
            out = []
            for rows in tiles(values, leaf):
                own = np.unique(labels[rows]).tolist()
                out.append(((part << 32) + trees, values.shape[1], own, ids[rows].tobytes(), labels[rows].tobytes(), _narrow(values[rows])))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            trees, held = trees + 1, []
            for i in range(0, len(out), 64):
                columns = zip(*out[i : i + 64])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "dim", "own", "ids", "labels", "values"])

    size, dim = 0, None
    for batch in found:
        ids, labels, dims = (batch.column(k).to_numpy() for k in range(3))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(dims)) + 1, [len(ids)]]) if len(ids) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            while a < b:
                if size == slab or (held and dim != dims[a]):
                    yield from emit()
                    size = 0
                dim, stop = dims[a], min(b, a + slab - size)
                held.append((ids[a:stop], labels[a:stop], _matrix(batch.column(3).slice(a, stop - a), stop - a)))
                size, a = size + stop - a, stop
    yield from emit()


def pack(vectors: DataFrame, slab: int = SLAB, leaf: int = LEAF) -> DataFrame:
    """The written leaves (tree, dim, own labels, ids, labels, values) of all rows of `taking_part`."""
    bounded_batches(vectors.sparkSession)
    keys = ["dim", "label", F.get("v", F.lit(0)), "row"]
    ordered = vectors.withColumn("row", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "label", "dim", "v")
    return stage(ordered.mapInArrow(partial(_packed, slab=slab, leaf=leaf), _LEAF))


# Search ---------------------------------------------------------------------


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows as 64-bit integers, those beyond 64 bits as the nearest."""
    most = (np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if most[0] < EXACT and most[1] < EXACT and most[0] * most[1] * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[list(map(int, r)) for r in m.tolist()] for m in (a, b)]
    return np.array([[max(-MOST, min(MOST, sum(x * y for x, y in zip(r, s)))) for s in whole[1]] for r in whole[0]], np.int64).reshape(len(a), len(b))


class Tree:
    """Leaves of one slab and the boxes above them, `FAN` to a box."""

    def __init__(self, dim: int, leaves: list[tuple[bytes, bytes, bytes]]):
        self.ids = [np.frombuffer(x[0], np.int64) for x in leaves]
        self.labels = [np.frombuffer(x[1], np.int64) for x in leaves]
        self.values = [_wide(x[2], len(i), dim) for x, i in zip(leaves, self.ids)]
        # Least and largest components and labels of each box.
        self.levels = [tuple(np.array([f(x, 0) for x in of]) for of in (self.values, self.labels) for f in (np.min, np.max))]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            self.levels.append(tuple((np.maximum if k % 2 else np.minimum).reduceat(x, at) for k, x in enumerate(self.levels[-1])))
        self.most = max((np.abs(v).max(initial=0) for v in self.values), default=0)

    def limits(self, level: int, first: int, end: int, up: np.ndarray, down: np.ndarray):
        """(lower, upper) limits of the inner products with each anchor, given its positive and negative parts."""
        lo, hi = (x[first:end] for x in self.levels[level][:2])
        return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T

    def search(self, values, labels, ids, slot_of, low, high, k: int, same: bool):
        """(slot, id, score) of the k best rows in each slot's score window, ties by id.

        Slot s belongs to anchor ``slot_of[s]``. Rows have its label if ``same``, else another one; a row
        with the anchor's own id never counts. ``self.opened`` counts the leaves read.
        """
        up, down = np.maximum(values, 0), np.minimum(values, 0)
        most = np.abs(values).max(initial=0)
        exact = most < EXACT and self.most < EXACT and most * self.most * values.shape[1] < EXACT
        none = np.zeros(0, np.int64)
        best, kth = [none, none, none], np.full(len(low), -MOST - 1)
        filled = np.zeros(len(low), np.int64)
        self.opened, queue, turn = 0, [], 0

        def wanted(level, node, lower, upper):
            """Slots for which a box has something to offer."""
            least, largest = self.levels[level][2][node], self.levels[level][3][node]
            own = (least <= labels) & (labels <= largest) if same else (least < labels) | (labels < largest)
            if not exact:
                return np.flatnonzero(own[slot_of])
            lower, upper = lower[slot_of], upper[slot_of]
            return np.flatnonzero(own[slot_of] & (upper >= low) & (lower <= high) & ((filled < k) | (upper >= kth)))

        def put(level, first, end):
            nonlocal turn
            lower, upper = self.limits(level, first, end, up, down) if exact else (np.zeros((len(values), end - first)),) * 2
            for j in range(end - first):
                slots = wanted(level, first + j, lower[:, j], upper[:, j])
                if len(slots):
                    offer = np.minimum(upper[slot_of[slots], j], high[slots]).max()
                    heapq.heappush(queue, (-offer, turn, level, first + j, lower[:, j], upper[:, j]))
                    turn += 1

        top = len(self.levels) - 1
        put(top, 0, len(self.levels[top][0]))
        while queue:
            _, _, level, node, lower, upper = heapq.heappop(queue)
            slots = wanted(level, node, lower, upper)
            if not len(slots):
                continue
            if level:
                put(level - 1, node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][0])))
                continue
            self.opened += 1
            anchors, of = np.unique(slot_of[slots], return_inverse=True)
            score = products(values[anchors], self.values[node])
            fits = (self.labels[node][None, :] == labels[anchors, None]) == same
            fits &= self.ids[node][None, :] != ids[anchors, None]
            score = score[of]
            ok = fits[of] & (score >= low[slots, None]) & (score <= high[slots, None]) & ((filled[slots, None] < k) | (score >= kth[slots, None]))
            s, r = np.nonzero(ok)
            if not len(s):
                continue
            rows = [np.concatenate(x) for x in zip(best, (slots[s], self.ids[node][r], score[s, r]))]
            order = np.lexsort((rows[1], -rows[2], rows[0]))
            rows = [x[order] for x in rows]
            begin = np.searchsorted(rows[0], np.arange(len(low)))
            keep = np.arange(len(order)) - begin[rows[0]] < k
            best = [x[keep] for x in rows]
            filled = np.bincount(best[0], minlength=len(low))
            last = np.cumsum(filled) - 1
            kth = np.where(filled == k, best[2][np.maximum(last, 0)], -MOST - 1)
        return best


def _searched(found, k: int, same: bool):
    """Streams each tree's leaves and then its anchors; anchors are searched in blocks."""
    tree, leaves, key, waiting = None, [], None, []

    def answer():
        nonlocal tree, leaves, waiting
        if not waiting:
            return
        if tree is None:
            tree, leaves = Tree(waiting[0]["dim"], leaves), []
        for i in range(0, len(waiting), BLOCK):
            block = waiting[i : i + BLOCK]
            values = np.concatenate([_wide(x["values"], 1, x["dim"]) for x in block])
            spans = [x["spans"] if x["spans"] is not None else [{"low": -MOST - 1, "high": MOST}] for x in block]
            slot_of = np.repeat(np.arange(len(block)), list(map(len, spans)))
            number = np.concatenate([np.arange(len(x)) for x in spans]).astype(np.int32)
            low, high = (np.array([w[end] for x in spans for w in x], np.int64) for end in ("low", "high"))
            slot, ids, score = tree.search(
                values, np.array([x["label"] for x in block]), np.array([x["id"] for x in block]), slot_of, low, high, k, same
            )
            a = np.array([x["a"] for x in block], np.int64)[slot_of[slot]]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(number[slot], pa.int32()), pa.array(ids), pa.array(score)], ["a", "slot", "id", "score"])
        waiting = []

    for batch in found:
        for row in batch.to_pylist():
            if (row["tree"], row["part"]) != key:
                yield from answer()
                tree, leaves, key = None, [], (row["tree"], row["part"])
            if row["a"] is None:
                leaves.append((row["ids"], row["labels"], row["values"]))
            else:
                waiting.append(row)
                if len(waiting) >= BLOCK:
                    yield from answer()
    yield from answer()


def search(leaves: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(a, slot, id, score, rank): the k best rows of each slot of each anchor, over all trees.

    ``anchors``: (a, id, label, dim, values, spans), ``spans`` the score windows of its slots or null for one
    slot without limits.
    """
    spark = leaves.sparkSession
    bounded_batches(spark)
    trees = leaves.select("dim", "tree").distinct()
    count = trees.count()
    parts = max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, count)))  # a tree's anchors may go to several tasks
    if same:
        of = leaves.select("dim", "tree", F.explode("own").alias("label")).distinct()
        met = anchors.join(of, ["dim", "label"])
    else:  # every anchor meets every tree of its dimension, by a group of trees at a time
        groups = -(-count // 1024)
        of = trees.withColumn("group", F.pmod(F.xxhash64("tree"), F.lit(max(1, groups))))
        each = anchors.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, groups - 1)).cast("long"))))
        met = each.join(of, ["dim", "group"]).drop("group")
    met = met.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts)))
    shelf = leaves.select("tree", "dim", "ids", "labels", "values", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    shelf = shelf.join(met.select("tree", "part").distinct(), ["tree", "part"], "left_semi") if same else shelf
    rows = shelf.unionByName(met, allowMissingColumns=True)
    tasks = min(max(1, count * parts), 20_000)
    rows = rows.repartition(tasks, "tree", "part").sortWithinPartitions("tree", "part", F.col("a").isNotNull())
    found = rows.mapInArrow(partial(_searched, k=k, same=same), _FOUND)
    best = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _flat(found):
    """Anchors' vectors as bytes."""
    for batch in found:
        values = [_narrow(_matrix(batch.column(3).slice(i, 1), 1)) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.binary())], ["id", "label", "dim", "values"])


def hard_negatives(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, slab: int = SLAB, leaf: int = LEAF
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Needs ``vec_id``, ``embedding`` and ``label``; other columns don't matter. Anchors are the rows whose id is
    divisible by ``every``; their positives are the best ``positives`` rows of their label, and of each
    positive with score p the negatives are the best ``negatives`` rows of other labels with
    ``low p <= 10 score <= high p``. Scores are inner products of floor(256 x), ties go to the smaller id.
    Rows without an id, label or vector, or with a null or non-finite component, take no part. Rows that share
    an id all count, but never for an anchor of that id; a repeated anchor is answered once for each row. Vectors of
    different lengths never meet; empty ones have score 0. Scores beyond 64 bits count as the nearest long.
    An empty table gives an empty result.
    """
    vectors = taking_part(rows)
    bounded_batches(rows.sparkSession)
    leaves = pack(vectors, slab, leaf)
    named = vectors.filter(F.col("id") % every == 0).mapInArrow(_flat, "id long, label long, dim int, values binary")
    anchors = stage(named.withColumn("a", F.monotonically_increasing_id()))
    no_span = F.lit(None).cast("array<struct<low:long,high:long>>")
    best = search(leaves, anchors.withColumn("spans", no_span), positives, same=True)
    pairs = stage(best.select("a", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score").cast("decimal(22,0)")
    span = F.struct(F.ceil(p * low / 10).cast("long").alias("low"), F.floor(p * high / 10).cast("long").alias("high"))
    spans = pairs.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("slot", span.alias("span")))).alias("spans"))  # at most `positives` each
    asked = anchors.join(spans.withColumn("spans", F.transform("spans", lambda x: x["span"])), "a")
    found = search(leaves, asked, negatives, same=False)
    out = found.join(pairs, ["a", "slot"]).join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
    columns = ("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return out.select(*columns)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# Ranks in SQL over all pairs of anchors and rows; only for tables of a few thousand rows.
OP11_SQL = """
WITH known AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM known a JOIN known b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank,
       n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 10
"""
