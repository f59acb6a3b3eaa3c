"""A fitted transform is a map without state, so it runs on a stream as it does on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def transform_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write transform(stream) to parquet files, each row once; with once all that is there now, then stop."""
    if not stream.isStreaming:
        raise ValueError("transform_stream takes a stream")
    writer = transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
