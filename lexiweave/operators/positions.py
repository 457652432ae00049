"""Where each string lies in the concatenation of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions.bytes import n_bytes

BLOCK = 1 << 16


def running_sum(df: DataFrame, value: str, out: str, idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """df with `out`: the sum of `value` over rows up to this one, in order of idx.

    Two steps: sums of blocks of idx, summed over the blocks, and within each
    block; only the blocks' sums meet in one task.
    """
    blocked = df.withColumn("_block", F.floor(F.col(idx) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy("_block").agg(F.sum(value).alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocked.join(starts, "_block").withColumn(out, (F.col("_before") + inside).cast("long")).drop("_block", "_before")


def positions(strings: DataFrame) -> DataFrame:
    """(idx, n_bytes, start_pos, end_pos) in bytes."""
    sized = strings.select("idx", n_bytes("s").alias("n_bytes"))
    return running_sum(sized, "n_bytes", "end_pos").select("idx", "n_bytes", (F.col("end_pos") - F.col("n_bytes")).alias("start_pos"), "end_pos")


def token_positions(encoded: DataFrame) -> DataFrame:
    """(idx, n_tokens, start_token, end_token): boundaries counted in tokens."""
    sized = encoded.select("idx", F.size("tokens").cast("long").alias("n_tokens"))
    return running_sum(sized, "n_tokens", "end_token").select("idx", "n_tokens", (F.col("end_token") - F.col("n_tokens")).alias("start_token"), "end_token")


def slices(strings: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (idx, at, size in bytes) cut out of the strings: (idx, at, size, part BINARY)."""
    return spans.join(strings, "idx").select("idx", "at", "size", F.substring(F.col("s").cast("binary"), F.col("at").cast("int") + 1, F.col("size").cast("int")).alias("part"))
