"""Encoding a stream of strings with a frozen dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexiweave.plans.codecs import Model


def encode_stream(strings: DataFrame, model: Model, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that appends (idx, tokens) of each micro-batch to Parquet at path. Parsing keeps no state, so nothing is ever late."""
    encoded = model.encode(strings)
    return encoded.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).outputMode("append").start(path)
