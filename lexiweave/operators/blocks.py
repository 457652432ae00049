"""Blocks of consecutive items of a bounded size, as a storage layout."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.operators.positions import running_sum

DEFAULT_BLOCK_SIZE = 64 * 1024
#: Items of a segment that one task blocks.
SEGMENT = 1 << 16
#: idx of a stretch in which queries look for their block.
WIDTH = 1 << 12


def assign(items: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE, segment: int | None = SEGMENT) -> DataFrame:
    """(idx, size, block_id) for items (idx, size).

    A block closes before the item that would exceed block_size; a larger item
    has a block to itself. If the first item is one, an empty block 0 precedes
    it. That is a running sum with resets, so it depends on every item before:
    each segment of so many idx first tells, as one task, where every item that
    may open its first block leads to; these are followed from segment to
    segment, and then each numbers its items. segment None: one segment.
    """
    seg = F.lit(0).cast("long") if segment is None else F.floor(F.col("idx") / segment)
    ordered = items.select(seg.alias("seg"), "idx", F.col("size").cast("long").alias("size"))

    def closings(sizes: np.ndarray) -> np.ndarray:
        """For each item, the next that opens a block if it opens one itself."""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return np.maximum(np.searchsorted(ends, ends[:-1] + block_size, side="right") - 1, np.arange(len(sizes)) + 1)

    def ends_of(key: tuple, table: pa.Table) -> pa.Table:
        """For each item that may be the first here to open a block: how many blocks end after it, and what the last holds."""
        sizes = table.sort_by("idx").column("size").to_numpy()
        ends, after = np.concatenate([[0], np.cumsum(sizes)]), closings(sizes)
        n = len(sizes)
        ended, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            j = int(after[i])
            ended[i], left[i] = (0, ends[n] - ends[i]) if j >= n else (ended[j] + 1, left[j])
        most = int(np.searchsorted(ends, block_size, side="right"))
        lists = [pa.array([x[:most].tolist()], pa.list_(pa.int64())) for x in (ends, ended, left)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([int(ends[n])], pa.int64()), *lists], names=["seg", "n", "size", "ends", "ended", "left"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ordered = table.sort_by("idx")
        sizes, held = ordered.column("size").to_numpy(), int(ordered.column("held")[0].as_py())
        block, out = int(ordered.column("start")[0].as_py()), np.empty(len(sizes), np.int64)
        ends, after = np.concatenate([[0], np.cumsum(sizes)]), closings(sizes)
        i = int(np.searchsorted(ends, block_size - held, side="right")) - 1 if held <= block_size else 0
        out[: max(0, i)] = block
        i = max(0, i)
        while i < len(sizes):
            block += 1
            j = int(after[i])
            out[i:j] = block
            i = j
        return pa.table({"idx": ordered.column("idx"), "size": ordered.column("size"), "block_id": out})

    if segment is None:
        first = ordered.withColumn("held", F.lit(0).cast("long")).withColumn("start", F.lit(0).cast("long"))
        return first.groupBy("seg").applyInArrow(run, "idx long, size long, block_id long")
    held = block = 0
    starts = []
    # a row for each segment, with as many places as items fit a block
    for r in ordered.groupBy("seg").applyInArrow(ends_of, "seg long, n long, size long, ends array<long>, ended array<long>, left array<long>").orderBy("seg").toLocalIterator():
        starts.append((r["seg"], held, block))
        i = max(0, bisect_right(r["ends"], block_size - held) - 1)
        if i == r["n"]:
            held += r["size"]
        else:
            block, held = block + 1 + r["ended"][i], r["left"][i]
    at = items.sparkSession.createDataFrame(starts, "seg long, held long, start long")
    return ordered.join(F.broadcast(at), "seg").groupBy("seg").applyInArrow(run, "idx long, size long, block_id long")


def metadata(assigned: DataFrame) -> DataFrame:
    """(block_id, end_position, num_items_psum, uncompressed_size) of the blocks, empty ones among them."""
    spark = assigned.sparkSession
    sums = assigned.groupBy("block_id").agg(F.count("*").alias("items"), F.sum("size").alias("bytes"))
    top = assigned.agg(F.max("block_id")).first()[0]
    every = spark.range(0 if top is None else top + 1).select(F.col("id").alias("block_id")).join(sums, "block_id", "left").fillna(0)
    summed = running_sum(running_sum(every, "bytes", "end_position", "block_id"), "items", "num_items_psum", "block_id")
    return summed.select("block_id", "end_position", "num_items_psum", F.col("bytes").cast("int").alias("uncompressed_size"))


def block_of(blocks: DataFrame, queries: DataFrame, width: int = WIDTH) -> DataFrame:
    """queries (qid, idx) with block_id: the first block whose num_items_psum is over idx.

    Blocks are dealt into stretches of `width` idx, a block of many items into
    several, and queries meet those of their own stretch: an equality join.
    """
    along = Window.partitionBy("_b").orderBy("block_id")
    # where a block starts: the end of the one before, over stretches of blocks and then within each
    placed = blocks.select("block_id", "num_items_psum", F.floor(F.col("block_id") / width).alias("_b"))
    lasts = placed.groupBy("_b").agg(F.max("num_items_psum").alias("_last")).withColumn("_before", F.lag("_last").over(Window.orderBy("_b"))).drop("_last")
    ranges = placed.withColumn("_lag", F.lag("num_items_psum").over(along)).join(lasts, "_b").select("block_id", F.coalesce("_lag", "_before", F.lit(0)).alias("_from"), F.col("num_items_psum").alias("_to")).where("_to > _from")
    each = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))))
    asked = queries.withColumn("_cell", F.floor(F.col("idx") / width))
    return asked.join(each, "_cell").where((F.col("idx") >= F.col("_from")) & (F.col("idx") < F.col("_to"))).drop("_from", "_to", "_cell")


def offsets(assigned: DataFrame) -> DataFrame:
    """(idx, block_id, offset, size): where in its block each item starts."""
    inside = Window.partitionBy("block_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return assigned.select("idx", "block_id", (F.sum("size").over(inside) - F.col("size")).alias("offset"), "size")


def compress(strings: DataFrame, assigned: DataFrame, level: int = 6) -> DataFrame:
    """(block_id, ends ARRAY<INT>, first_idx, data BINARY): each block's strings, deflated together."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ordered = table.sort_by("idx")
        parts = ordered.column("b").to_pylist()
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
        return pa.table({"block_id": [key[0].as_py()], "first_idx": [ordered.column("idx")[0].as_py()], "ends": pa.array([ends], pa.list_(pa.int32())), "data": pa.array([zlib.compress(b"".join(parts), level)])})

    rows = strings.join(assigned.select("idx", "block_id"), "idx").select("block_id", "idx", F.col("s").cast("binary").alias("b"))
    return rows.groupBy("block_id").applyInArrow(run, "block_id long, first_idx long, ends array<int>, data binary")


def decompress(compressed: DataFrame) -> DataFrame:
    """(idx, s) of all blocks."""

    def run(batches):
        for batch in batches:
            idx, out = [], []
            for first, ends, data in zip(*(c.to_pylist() for c in batch.columns)):
                whole, start = zlib.decompress(data), 0
                for k, end in enumerate(ends):
                    idx.append(first + k)
                    out.append(whole[start:end])
                    start = end
            yield pa.record_batch([pa.array(idx, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["idx", "s"])

    return compressed.select("first_idx", "ends", "data").mapInArrow(run, "idx long, s string")


def lookup(compressed: DataFrame, assigned: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, idx, s): only the blocks asked for are inflated."""
    wanted = queries.join(assigned.select("idx", "block_id"), "idx")
    decoded = decompress(compressed.join(wanted.select("block_id").distinct(), "block_id", "left_semi"))
    return queries.join(decoded, "idx").select("qid", "idx", "s")


class BlockCache:
    """Inflated blocks (block_id, idx, s), kept on the executors until they are dropped."""

    def __init__(self, compressed: DataFrame, assigned: DataFrame):
        self.compressed, self.assigned, self.held = compressed, assigned.select("idx", "block_id"), {}

    def load(self, *block_ids: int) -> DataFrame:
        """Inflates the blocks that aren't held yet, and gives them all."""
        new = [b for b in block_ids if b not in self.held]
        if new:
            rows = decompress(self.compressed.where(F.col("block_id").isin(new))).join(self.assigned.where(F.col("block_id").isin(new)), "idx").persist()
            self.held.update(dict.fromkeys(new, rows))
        out = None
        for df in dict.fromkeys(self.held[b] for b in block_ids):
            out = df if out is None else out.unionByName(df)
        empty = self.assigned.limit(0).select("idx", F.lit("").alias("s"), "block_id")
        return (empty if out is None else out).where(F.col("block_id").isin(list(block_ids)))

    def get(self, block_id: int, idx: int) -> str | None:
        """One string of a block; None if it isn't there."""
        row = self.load(block_id).where((F.col("idx") == idx) & (F.col("block_id") == block_id)).select("s").first()
        return row["s"] if row else None

    def drop(self) -> None:
        for df in dict.fromkeys(self.held.values()):
            df.unpersist()
        self.held.clear()
