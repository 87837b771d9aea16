"""Near copies among embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

1. Equal vectors of a label become one class with a count; only classes are compared.
2. *Iterative quantisation* (Gong and Lazebnik, 2011): principal components of a bounded sample, then a rotation
   learnt by turns with the nearest sign codes. The codes of all vectors have at most 64 bits.
3. *Multi-index tables* (Norouzi et al., 2012): the bits are dealt to `TABLES` chunks. Two vectors meet if a
   chunk of their codes is equal, so all pairs with fewer differing bits than chunks meet, and most others
   that are near: a pair with b differing bits is missed only if those lie in all chunks. The first equal chunk
   is a pair's own, so a pair is counted once although it may meet in several tables.
4. In the tables only codes travel. A vector goes on, with the tables that matter to it, if some pair of its
   own differs in at most a quarter of the bits.
5. *Rerank*: the tables are visited again with the original vectors, cosines in double precision.

Buckets beyond `BLOCK` rows are split into blocks, and every pair of blocks is a group of its own, so neither a
common code nor thousands of near copies meet in one task. No pair leaves a task: a group gives each class its
number of links, and edges enough to join what its links join.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_batches, stage
from .components import components

SAMPLE = 20_000  # most vectors that the rotation is learnt from
TURNS = 50
TABLES, BITS = 6, 64
BLOCK, TILE = 4096, 1024  # rows of a block of a bucket; rows compared at once
NEAR = 4  # pairs that differ in more than one of so many bits aren't candidates
UNSURE = 1e-9  # cosines this near the threshold are computed again, pair by pair


# Codes ----------------------------------------------------------------------


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two next to their largest component, so that no square overflows."""
    _, power = np.frexp(np.abs(vectors).max(1, initial=0))
    return np.ldexp(vectors, -power[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def rotation(sample: np.ndarray, bits: int = BITS, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal components of unit vectors, rotated so that their signs lose least."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(bits, sample.shape[1])]
    turned = np.linalg.qr(np.random.default_rng(0).normal(size=(axes.shape[1],) * 2))[0]
    reduced = centred @ axes
    for _ in range(turns):
        code = np.where(reduced @ turned >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(reduced.T @ code)
        turned = left @ right
    return mean, axes @ turned


def codes(vectors: np.ndarray, model: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sign bits as 64-bit numbers; vectors of a length that the sample lacks give the signs of their first components."""
    dim = vectors.shape[1]
    mean, projection = model[dim] if dim in model else (np.zeros(dim), np.eye(dim)[:, :BITS])
    bits = np.zeros((len(vectors), BITS), np.uint8)
    bits[:, : projection.shape[1]] = (unit(vectors) - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()


def chunk_masks(bits: int, tables: int = TABLES) -> list[int]:
    """The bits of each table: every ``tables``-th one."""
    return [sum(1 << b for b in range(t, bits, tables)) for t in range(tables)]


def _flat(column: pa.Array) -> list[np.ndarray]:
    """The vectors of an array column."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _coded(found, model):
    for batch in found:
        vectors = _flat(batch.column(1))
        dims = np.array([len(v) for v in vectors])
        out = np.zeros(len(vectors), np.int64)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            out[at] = codes(np.stack([vectors[i] for i in at]), model.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(dims, pa.int32()), pa.array(out)], ["id", "label", "copies", "dim", "code"])


# Groups of a table ----------------------------------------------------------


def _groups(found, columns: int):
    """Rows of each (table, label, dim, key, i, j) group of a sorted partition, as lists of column arrays."""
    held, key = [], None
    for batch in found:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(6)], 1)
        edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        for a, b in zip(edges[:-1], edges[1:]):
            now = tuple(keys[a].tolist())
            if now != key and held:
                yield key, held
                held = []
            key = now
            held.append([batch.column(6 + k).slice(a, b - a) for k in range(columns)])
    if held:
        yield key, held


def _tiles(block: np.ndarray, i: int, j: int):
    """Pairs of row ranges that a group compares: all of one block, or one block with the other."""
    parts = [np.flatnonzero(block == x) for x in sorted({i, j})]
    cut = [[p[k : k + TILE] for k in range(0, len(p), TILE)] for p in parts]
    if i == j:
        yield from ((x, y) for k, x in enumerate(cut[0]) for y in cut[0][k:])
    elif len(cut) == 2:
        yield from ((x, y) for x in cut[0] for y in cut[1])


def _own_pairs(x: np.ndarray, y: np.ndarray, table: int, masks) -> np.ndarray:
    """Where two codes don't already meet in an earlier table."""
    differ = x[:, None] ^ y[None, :]
    out = np.ones(differ.shape, bool)
    for m in masks[:table]:
        out &= (differ & np.int64(m)) != 0
    return out


def _candidates(found, near: int):
    """(id, table) of the rows that have a near code among the pairs of a group."""
    for (table, _, dim, *_, i, j), held in _groups(found, 3):
        ids, code, block = (np.concatenate([h[k].to_numpy() for h in held]) for k in range(3))
        bits = min(BITS, dim)
        masks = [np.uint64(m).astype(np.int64) for m in chunk_masks(bits)]
        hit = np.zeros(len(ids), bool)
        for x, y in _tiles(block, i, j):
            close = np.bitwise_count((code[x][:, None] ^ code[y][None, :]).view(np.uint64)) * near <= bits
            if x is y or (len(x) == len(y) and x[0] == y[0]):
                close &= ~np.eye(len(x), dtype=bool)
            if close.any():
                close &= _own_pairs(code[x], code[y], table, masks)
                hit[x] |= close.any(1)
                hit[y] |= close.any(0)
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(np.full(hit.sum(), table), pa.int32())], ["id", "t"])


def cosines(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows reach the cosine; those too near the threshold for a matrix product are computed one by one."""
    value = unit(x) @ unit(y).T
    out = value >= least
    a, b = scaled(x), scaled(y)
    for i, j in zip(*np.nonzero(np.abs(value - least) < UNSURE)):
        out[i, j] = (a[i] * b[j]).sum() / (np.sqrt((a[i] * a[i]).sum()) * np.sqrt((b[j] * b[j]).sum())) >= least
    return out


def _least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _linked(found, least: float):
    """(id, other, links): links of a class with others of a group, counted with copies, and an edge to the group's smallest class it reaches."""
    for (table, _, dim, *_, i, j), held in _groups(found, 5):
        ids, code, block, copies = (np.concatenate([h[k].to_numpy() for h in held]) for k in range(4))
        vectors = np.stack([v for h in held for v in _flat(h[4])])
        order = np.argsort(ids)
        ids, code, block, copies, vectors = (z[order] for z in (ids, code, block, copies, vectors))
        masks = [np.uint64(m).astype(np.int64) for m in chunk_masks(min(BITS, dim))]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for x, y in _tiles(block, i, j):
            joined = cosines(vectors[x], vectors[y], least) & _own_pairs(code[x], code[y], table, masks)
            own = len(x) == len(y) and x[0] == y[0]
            if own:
                joined &= ~np.eye(len(x), dtype=bool)
            if joined.any():
                links[x] += joined @ copies[y]
                if not own:
                    links[y] += copies[x] @ joined
                a, b = np.nonzero(joined)
                # Earlier tiles' results are one edge for each row.
                root = _least_joined(len(ids), np.concatenate([x[a], np.arange(len(ids))]), np.concatenate([y[b], root]))
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], ["id", "other", "links"])


class Copies:
    """One search; the steps are methods so that tests can look at each."""

    def __init__(self, rows: DataFrame, least: float = 0.98, sample: int = SAMPLE, block: int = BLOCK):
        spark = rows.sparkSession
        bounded_batches(spark)
        self.spark, self.least, self.block = spark, least, block
        v, label = F.col("embedding").cast("array<double>"), F.col("label").cast("long")
        finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
        takes = label.isNotNull() & F.coalesce(finite, F.lit(False))
        # -0.0 and 0.0 are one value to a comparison but not to a group.
        self.rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.when(takes, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
        one = self.rows.filter("v is not null").groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        self.classes = stage(one.withColumn("id", F.monotonically_increasing_id()))
        # The sample is the same on every run: the vectors with the smallest hashes.
        drawn = self.classes.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(sample).select("v").toArrow().column(0).combine_chunks()
        vectors, by = _flat(drawn) if len(drawn) else [], {}
        for x in vectors:
            by.setdefault(len(x), []).append(x)
        self.model = {d: rotation(unit(np.stack(x))) for d, x in sorted(by.items())}
        shared = spark.sparkContext.broadcast(self.model)
        coded = self.classes.select("id", "v", "label", "copies").mapInArrow(partial(_coded, model=shared), "id long, label long, copies long, dim int, code long")
        self.codes = stage(coded)

    def entries(self) -> DataFrame:
        """(t, label, dim, key, i, j, id, code, block): each code in each group of each of its buckets."""
        bits = F.least("dim", F.lit(BITS))
        mine = [F.array(*[F.lit(np.uint64(m).astype(np.int64).item()) for m in chunk_masks(b)]) for b in range(BITS + 1)]
        masks = F.element_at(F.array(*mine), bits + 1)
        key = F.col("code").bitwiseAND(F.element_at(masks, F.col("t") + 1))
        tables = F.explode(F.array(*[F.lit(t) for t in range(TABLES)])).alias("t")
        rows = self.codes.select("id", "label", "dim", "code", tables).select("t", "label", "dim", key.alias("key"), "id", "code")
        group = ["t", "label", "dim", "key"]
        sizes = stage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        large = sizes.filter(F.col("size") > self.block)
        # At most rows / block of them; the others lie in one block.
        large = F.broadcast(large) if large.count() * 64 <= BROADCAST_BYTES else large
        rows = rows.join(large.withColumn("blocks", F.ceil(F.col("size") / self.block).cast("int")).drop("size"), group, "left")
        rows = rows.withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0).cast("long")).cast("int"))
        pairs = F.transform(
            F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)).cast("int") - 1),
            lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")),
        )
        return rows.withColumn("pair", F.explode(pairs)).select(*group, F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "id", "code", "block")

    def _grouped(self, rows: DataFrame) -> DataFrame:
        keys = ["t", "label", "dim", "key", "i", "j"]
        return rows.repartition(*keys).sortWithinPartitions(*keys)

    def candidates(self) -> DataFrame:
        """(id, t) of the classes that have a near code in table t."""
        found = self._grouped(self.entries()).mapInArrow(partial(_candidates, near=NEAR), "id long, t int")
        return stage(found.distinct())

    def links(self) -> DataFrame:
        """(id, other, links) by group: partial link counts, and edges that join each component."""
        rows = self.entries().join(self.candidates(), ["id", "t"], "left_semi")
        rows = rows.join(self.classes.select("id", "copies", "v"), "id")
        rows = rows.select("t", "label", "dim", "key", "i", "j", "id", "code", "block", "copies", "v")
        return stage(self._grouped(rows).mapInArrow(partial(_linked, least=self.least), "id long, other long, links long"))

    def membership(self) -> DataFrame:
        found = self.links()
        degree = found.groupBy("id").agg(F.sum("links").alias("links"))
        joined = components(found.select(F.col("id").alias("u"), F.col("other").alias("v")))
        of = self.classes.select("id", "label", "v", "copies", "least").join(degree, "id", "left").join(joined, "id", "left")
        of = of.withColumn("component", F.coalesce("component", "id"))
        # Numbers of classes follow no order of ids: the smallest id of each component is looked up.
        least = of.groupBy("component").agg(F.min("least").alias("component_id"))
        of = of.join(least, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        known = self.rows.filter("v is not null").join(of, ["label", "v"])
        alone = self.rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = known.select("vec_id", "n_links", "component_id").unionByName(alone)
        return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def embedding_copies(rows: DataFrame, least: float = 0.98, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Needs ``vec_id``, ``embedding`` and ``label``; other columns don't matter. Rows link if their labels are equal
    and their cosine is at least ``least``. Rows without a label or vector, zero vectors and those with a null or
    non-finite component link with nothing; vectors of different lengths don't either. ``n_links`` counts
    other rows, so a repeated row links with its repetition, and ``component_id`` is the smallest id reached. Rows
    without an id count and are joined like others; only where no row of a component has an id it is
    null. ``kept`` marks rows whose id is their component's. An empty table gives an empty result.

    Every link reported is verified with the original vectors. A link is found unless its codes differ in all
    chunks: with 64 bits, never below six differing bits.
    """
    return Copies(rows, least, sample, block).membership()


def op12_embedding_copies(spark, sf_dir: str) -> DataFrame:
    return embedding_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
