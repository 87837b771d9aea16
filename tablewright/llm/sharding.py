"""Shards from a permutation-filled lookup table (Maglev hashing, Eisenbud et al., 2016).

Every shard has its own permutation of the slots of a prime-sized table, from two
hashes of its name. Shards take turns, each claiming the first free slot of its
preference list, until the table is full: loads differ by a slot, and when a shard
leaves, few other slots change. The table has a fixed size (65 537 rows by default),
so it is broadcast; a row finds its shard by one hash and one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537  # a prime; a hundred slots for each shard and more keep loads even
SHARDS = 64


def _hash(text: str, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, person=salt).digest(), "little")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] | Mapping[str, float], slots: int = SLOTS) -> np.ndarray:
    """The shard number of every slot.

    With a mapping, a shard of weight w claims in proportion to w: it saves its weight
    each turn and claims while it has saved the largest weight. Names must be distinct.
    """
    names = list(shards)
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or slots < len(names):
        raise ValueError(f"{slots} slots: a prime number of at least the number of shards is needed")
    weight = np.array([float(shards[n]) for n in names] if isinstance(shards, Mapping) else [1.0] * len(names))
    if (weight <= 0).any():
        raise ValueError("weights must be positive")
    offset = [_hash(n, b"offset") % slots for n in names]
    skip = [1 + _hash(n, b"skip") % (slots - 1) for n in names]
    table, step, saved, left = np.full(slots, -1, np.int32), [0] * len(names), np.zeros(len(names)), slots
    while left:
        saved += weight
        for k in np.flatnonzero(saved >= weight.max()):
            if not left:
                break
            saved[k] -= weight.max()
            while table[slot := (offset[k] + step[k] * skip[k]) % slots] >= 0:
                step[k] += 1
            table[slot] = k
            left -= 1
    return table


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str] | Mapping[str, float], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Adds the slot of each row's keys and the name of its shard.

    Equal keys share a shard, null keys as well. Columns ``slot`` and ``shard`` must not exist.
    Choose keys that spread the rows (an id rather than a source): a shard can't split one key.
    """
    if clash := {slot, shard} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist; name others")
    names = list(shards)
    rows = [(i, names[k]) for i, k in enumerate(lookup_table(shards, slots).tolist())]
    table = df.sparkSession.createDataFrame(rows, f"`{slot}` int, `{shard}` string")
    placed = df.withColumn(slot, F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(table), slot).select(*[f"`{c}`" for c in df.columns], f"`{slot}`", f"`{shard}`")


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def write_shards(df: DataFrame, path: str, keys: Sequence[str], shards: Sequence[str] | Mapping[str, float], slots: int = SLOTS, files: int = 4) -> None:
    """Writes a folder for each shard; a shard's rows are dealt over ``files`` tasks, so that no task holds a whole one."""
    placed = place(df, keys, shards, slots)
    names = list(shards)
    placed = placed.repartition(len(names) * files, "shard", F.col("slot") % files)
    placed.drop("slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(docs.select("doc_id"), ["doc_id"], shard_names(SHARDS))
