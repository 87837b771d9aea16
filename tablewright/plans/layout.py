"""Row positions without a single-task window.

Spark rows have no position. For a table or a group that fits one task a plain
``row_number`` window is used. Beyond `hot_limit` rows the table is range
partitioned by the whole order, sorted, and written once to the cluster's shared
checkpoint folder together with each row's partition and offset; the position is
then the offset plus the row count of the earlier partitions. The written table
survives lost executors and fixes the range bounds, which a re-run of the shuffle
would not.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .names import Order, UniqueOrder, range_columns, ref, sort_columns, total_order

HOT_ROWS_CONF = "spark.tablewright.hotGroupRows"
HOT_ROWS_DEFAULT = 2_000_000
SMALL_ROWS = 500_000  # most rows ever broadcast, checked by a count
TOP_ROWS = 100_000  # most rows a top-n may bring into one task

RN, CNT, PID, OFF = "__rn", "__cnt", "__pid", "__off"


def hot_limit(spark: SparkSession) -> int:
    """Rows of one group that a single task may sort."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


@functools.cache
def _local_staging(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="spark-tablewright-")


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local"):
        return _local_staging(spark.conf.get("spark.app.id", ""))
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def stage(df: DataFrame) -> DataFrame:
    """Write the table once and read it back: later scans prune its columns."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/tablewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A derived table, computed once, with a broadcast hint only if a count proves it small.

    Otherwise AQE chooses the join.
    """
    ready = stage(df)
    return F.broadcast(ready) if ready.count() <= limit else ready


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys, keeping each key once."""
    renamed = small.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    renamed = broadcast_if_small(renamed)
    cond = F.lit(True)
    for k in keys:
        cond = cond & ref(k).eqNullSafe(ref(f"__k_{k}"))
    return df.join(renamed, cond, "left").drop(*[f"__k_{k}" for k in keys])


def side_by_side(parts: Sequence[DataFrame], keys: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Aggregates of the same groups as one table: a union, regrouped, so null keys meet.

    (A scalar subquery per value would be run again for every reference to it.)
    """
    if len(parts) == 1:
        return parts[0].select(*[ref(c) for c in [*keys, *outputs]])
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [F.any_value(ref(o), True).alias(o) for o in outputs]
    return stacked.groupBy(*[ref(k) for k in keys]).agg(*values)


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys of the groups above the limit with their row counts, or None.

    One aggregate with map-side combine over the key columns. There are at most
    ``rows / limit`` such groups, so the result is small by construction.
    """
    limit = hot_limit(df.sparkSession) if limit is None else limit
    hot = df.groupBy(*[ref(k) for k in keys]).agg(F.count(F.lit(1)).alias(CNT)).filter(F.col(CNT) > limit)
    if keys:
        return None if hot.isEmpty() else stage(hot)
    rows = df.count()
    return df.sparkSession.range(1).select(F.lit(rows).alias(CNT)) if rows > limit else None


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of cold groups, rows of hot groups)."""
    marks = broadcast_if_small(hot.select(*[ref(k).alias(f"__k_{k}") for k in keys]))
    cond = functools.reduce(lambda a, b: a & b, [ref(k).eqNullSafe(ref(f"__k_{k}")) for k in keys])
    return df.join(marks, cond, "left_anti"), df.join(marks, cond, "left_semi")


def range_partitions(spark: SparkSession, rows: int) -> int:
    """As many as a shuffle has, more only for very large tables.

    A range partition is sorted with spilling and is no group of a task, so a low hot limit makes no more of them:
    Spark samples some hundred rows per partition to the driver for the bounds.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // max(hot_limit(spark), HOT_ROWS_DEFAULT)))


def laid_out(df: DataFrame, order: Sequence[tuple[str, bool]], rows: int) -> DataFrame:
    """Range partitioned and sorted by ``order``, written, with partition and offset."""
    parts = range_partitions(df.sparkSession, rows)
    keys = range_columns(df, order) or [F.lit(0)]
    ordered = df.repartitionByRange(min(parts, SMALL_ROWS), *keys).sortWithinPartitions(*sort_columns(order))
    return stage(
        ordered.withColumn(PID, F.spark_partition_id()).withColumn(
            OFF, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )


def number_large(df: DataFrame, keys: Sequence[str], order_by: Order, rows: int) -> DataFrame:
    """Adds ``__rn`` (1-based within the group) and ``__cnt`` (rows of the group).

    For few groups of many rows: the carried counts are one row per group and
    range partition.
    """
    laid = laid_out(df, total_order(df, order_by, first=keys), rows)
    seg = laid.groupBy(*[ref(k) for k in keys], PID).agg(F.count(F.lit(1)).alias("__n"), F.min(OFF).alias("__lo"))
    group = Window.partitionBy(*[ref(k) for k in keys])
    before = group.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select(
        *[ref(k) for k in keys],
        F.col(PID),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__lo") + 1).alias("__base"),
        F.sum("__n").over(group).alias(CNT),
    )
    seg = seg.withColumnRenamed(PID, "__seg_pid")
    cond = F.col(PID) == F.col("__seg_pid")
    seg = seg.select(*[ref(k).alias(f"__k_{k}") for k in keys], "__seg_pid", "__base", CNT)
    for k in keys:
        cond = cond & ref(k).eqNullSafe(ref(f"__k_{k}"))
    return laid.join(broadcast_if_small(seg), cond).select(
        *[ref(c) for c in df.columns], (F.col(OFF) + F.col("__base")).alias(RN), F.col(CNT)
    )


def positions(df: DataFrame, order_by: Order, name: str = RN) -> DataFrame:
    """The table with a consecutive 1-based position in the given order."""
    rows = df.count()
    if rows <= hot_limit(df.sparkSession):
        window = Window.orderBy(*sort_columns(total_order(df, order_by)))
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    out = number_large(df, [], order_by, rows)
    return out.select(*[ref(c) for c in df.columns if c != name], F.col(RN).alias(name))


def top(df: DataFrame, order_by: Order, n: int, reverse: bool = False) -> DataFrame:
    """The first (or last) n rows: a heap per task when n is small."""
    items = total_order(df, order_by)
    if n <= TOP_ROWS:
        return df.orderBy(*sort_columns(items, reverse)).limit(n)
    ordered = positions(df, UniqueOrder((c, "desc" if d else "asc") for c, d in items))
    keep = F.col(RN) > df.count() - n if reverse else F.col(RN) <= n
    return ordered.filter(keep).drop(RN)


__all__ = [
    "CNT", "RN", "attach", "broadcast_if_small", "hot_groups", "hot_limit", "laid_out", "number_large", "positions", "side_by_side", "split_hot", "stage", "top",
]
