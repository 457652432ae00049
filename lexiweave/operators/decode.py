"""Token ids back to strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(idx, s) from (idx, tokens). The dictionary (token_id dense from 0) is one array of hex strings, a scalar to the query; bytes are joined before the text is made, as a token may hold part of a character."""
    table = dictionary.agg(F.sort_array(F.collect_list(F.struct("token_id", F.hex("token").alias("h")))).alias("d")).select("d.h")
    joined = encoded.withColumn("_hex", table.scalar())
    return joined.select(*[c for c in encoded.columns if c != "tokens"], F.unhex(F.array_join(F.transform("tokens", lambda t: F.element_at("_hex", t + 1)), "")).cast("string").alias("s"))


def decode_relational(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same by a join on token_id, for dictionaries too large for one row."""
    each = encoded.select("idx", F.posexplode_outer("tokens").alias("pos", "token_id"))
    hexed = each.join(dictionary.select("token_id", F.hex("token").alias("h")), "token_id", "left")
    together = hexed.groupBy("idx").agg(F.sort_array(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("pos", "h")))).alias("p"))
    return together.select("idx", F.unhex(F.array_join(F.col("p.h"), "")).cast("string").alias("s"))


def _parts(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Runs of rows with about so many tokens, one row at least."""
    ends = batch.column(column).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def decode_arrow(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """The same by an Arrow function: the bytes of a batch's tokens are gathered at once from the broadcast dictionary."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    shared = encoded.sparkSession.sparkContext.broadcast((b"".join(tokens), np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes))
    rest = [c for c in encoded.columns if c != "tokens"]
    schema = T.StructType([*[encoded.schema[c] for c in rest], T.StructField("s", T.StringType())])

    def run(batches):
        data, starts, sizes = shared.value
        data = np.frombuffer(data, np.uint8)
        for batch in batches:
            for part in _parts(batch, len(rest)):
                lists = part.column(len(rest))
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                width = sizes[ids]
                stop = np.concatenate([[0], np.cumsum(width)])
                flat = data[np.repeat(starts[ids] - stop[:-1], width) + np.arange(stop[-1])]
                ends = stop[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
                binary = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], binary.cast(pa.binary()).view(pa.string())], names=schema.names)

    return encoded.select(*rest, "tokens").mapInArrow(run, schema)


def lookup(encoded: DataFrame, tokens: list[bytes], queries: DataFrame) -> DataFrame:
    """(qid, idx, s) for queries (qid, idx): only the rows asked for are decoded."""
    asked = queries.join(encoded.select("idx", "tokens"), "idx").select("qid", "idx", "tokens")
    return decode_arrow(asked, tokens)
