"""Streaming input.

There are no streaming operators: projections, filters, replacements, type
conversions and the column functions are plain Column expressions and run on a
streaming DataFrame unchanged. What depends on row order or on a count of all
rows calls `require_batch` and refuses a stream.
"""

from pyspark.sql import DataFrame


def require_batch(df: DataFrame, operation: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{operation} needs all rows and cannot run on a streaming DataFrame")
