"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.layout import stage

BATCH_ROWS = 1000  # rows of an Arrow batch: with texts of 100 kB still about 100 MB
BROADCAST_BYTES = 16 << 20  # most bytes ever broadcast, proven by a count of fixed-width rows


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch, so that batches of long texts fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_texts(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """`function` over the Arrow batches of ``df``, one result batch (or several) for each."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            out = function(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def lists(values, lengths, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, kind))


def broadcast_ids(ids: DataFrame) -> DataFrame:
    """A staged table of a few short columns, with a broadcast hint only if its count keeps it below `BROADCAST_BYTES`."""
    return F.broadcast(ids) if ids.count() * 64 <= BROADCAST_BYTES else ids


__all__ = ["BATCH_ROWS", "BROADCAST_BYTES", "bounded_batches", "broadcast_ids", "lists", "map_texts", "stage"]
