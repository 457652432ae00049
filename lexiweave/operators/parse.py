"""Strings to token ids with a fixed dictionary."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.operators.train import Matcher, every_second


def collected(dictionary: DataFrame) -> list[bytes]:
    """The tokens by id; a dictionary has as many as its codec's ids at most."""
    return [bytes(r["token"]) for r in dictionary.select("token_id", "token").orderBy("token_id").collect()]


#: Bytes of strings that a task parses before it sends their tokens.
_SLICE = 4 << 20


def slices(batches, column: int = 1, limit: int = _SLICE):
    """Batches cut into runs of rows with about `limit` bytes in a column, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _mapped(strings: DataFrame, parse_with) -> DataFrame:
    """(idx, tokens) by an Arrow function; a task parses a string that comes again once."""

    def run(batches):
        parse, held = parse_with(), {}
        for batch in slices(batches):
            out = []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                tokens = held.get(data)
                if tokens is None:
                    tokens = parse(data)
                    if len(data) <= 256 and len(held) < 100_000:
                        held[data] = tokens
                out.append(tokens)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["idx", "tokens"])

    return strings.select("idx", "s").mapInArrow(run, "idx long, tokens array<int>")


def parse(strings: DataFrame, tokens: list[bytes]) -> DataFrame:
    """Greedy longest match from the left, by an Arrow function over a broadcast dictionary."""
    shared = strings.sparkSession.sparkContext.broadcast(tokens)
    return _mapped(strings, lambda: Matcher(shared.value).parse)


def parse_native(strings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same by a join and a fold, for dictionaries of short tokens: as many rows as bytes times token lengths.

    Equal strings are parsed once.
    """
    lengths = sorted(r[0] for r in dictionary.select("token_len").distinct().collect())
    distinct = strings.where(F.octet_length("s") > 0).select("s").distinct().withColumn("b", F.col("s").cast("binary"))
    places = distinct.withColumn("pos", F.explode(F.expr("sequence(1, octet_length(b))")))
    spans = places.withColumn("len", F.explode(F.array(*[F.lit(n) for n in lengths]))).where("pos + len - 1 <= octet_length(b)")
    found = spans.withColumn("token", F.expr("substring(b, pos, len)")).join(F.broadcast(dictionary.select("token", "token_id")), "token")
    best = found.groupBy("s", "pos").agg(F.max(F.struct("len", "token_id")).alias("best"))
    path = best.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("best.len").alias("len"), F.col("best.token_id").alias("token_id")))).alias("path"))
    # tokens are appended to a short list that is put away when it is full, so that a step copies little
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("tokens"))

    def step(state, p):
        full = F.size(state["tokens"]) >= 64
        done = F.when(full, F.concat(state["done"], F.array(state["tokens"]))).otherwise(state["done"])
        tokens = F.when(full, F.array(p["token_id"])).otherwise(F.concat(state["tokens"], F.array(p["token_id"])))
        taken = F.struct((state["next"] + p["len"]).alias("next"), done.alias("done"), tokens.alias("tokens"))
        return F.when(p["pos"] == state["next"], taken).otherwise(state)

    walked = path.select("s", F.aggregate("path", start, step, lambda state: F.flatten(F.concat(state["done"], F.array(state["tokens"])))).alias("tokens"))
    return strings.join(walked, "s", "left").select("idx", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"))


def _gathered(batches, column: int = 1, limit: int = _SLICE):
    """The slices of batches, small ones put together to about `limit` bytes."""
    held, size = [], 0
    for batch in slices(batches, column, limit):
        if held and size + batch.column(column).nbytes > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.column(column).nbytes
    if held:
        yield pa.Table.from_batches(held)


def _replayed(strings: list[bytes], keys: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all strings in a row, and the ends of each string's; keys are the pairs that merge, left << 32 | right, sorted, and made their tokens."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    size = int(ends[-1])
    # the place after the last stands for no neighbour
    tokens = np.full(size + 1, -1, np.int64)
    tokens[:size] = np.frombuffer(b"".join(strings), np.uint8)
    after, before = np.arange(1, size + 2), np.arange(-1, size)
    some = np.flatnonzero(sizes)
    after[ends[some + 1] - 1], before[ends[some]], after[size] = size, size, size
    line, where = [], {}  # pairs wait by the token that they make

    def put(at: np.ndarray) -> None:
        """Places whose pairs with what follows merge; a pair's places all come at once, when the newer of its tokens is made."""
        pairs = tokens[at] << 32 | tokens[after[at]]
        found = np.searchsorted(keys, pairs)
        found[found == len(keys)] = 0
        good = np.flatnonzero(keys[found] == pairs)
        if not len(good):
            return
        token, at = made[found[good]], at[good]
        order = np.argsort(token, kind="stable")
        token, at = token[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])).tolist()
        for t, i, j in zip(token[first].tolist(), first, [*first[1:], len(at)]):
            where[t] = at[i:j]
            heappush(line, t)

    pair_of = dict(zip(made.tolist(), keys.tolist()))
    if len(keys):
        put(np.flatnonzero(after[:size] < size))
    while line:
        token = heappop(line)
        at, pair = where.pop(token), pair_of[token]
        at = at[(tokens[at] << 32 | tokens[after[at]]) == pair]
        if not len(at):
            continue
        if pair >> 32 == pair & 0xFFFFFFFF:
            at = every_second(at, after)
        second = after[at]
        right = after[second]
        tokens[at], tokens[second] = token, -1
        after[at], before[right] = right, at
        left = before[at]
        left = left[(tokens[left] >= 0) & (tokens[left] != token)]  # two new ones side by side are met from the left
        put(left)
        put(at[tokens[right] >= 0])
    here = tokens[:size] >= 0
    return tokens[:size][here], np.concatenate([[0], np.cumsum(here)])[ends]


def replay(strings: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(idx, tokens) by byte-pair merges (token, left, right) in the order of their ids, each from the left everywhere.

    A merge goes through all the strings that a task holds at a time; strings
    that come again among these are merged once.
    """
    shared = strings.sparkSession.sparkContext.broadcast(merges)

    def run(batches):
        pairs = sorted((left << 32 | right, token) for token, left, right in shared.value)
        keys, made = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        for table in _gathered(batches):
            once = table.column(1).combine_chunks().cast(pa.binary()).dictionary_encode()
            tokens, ends = _replayed(once.dictionary.to_pylist(), keys, made)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32()))
            yield from pa.table({"idx": table.column(0), "tokens": lists.take(once.indices)}).to_batches()

    return strings.select("idx", "s").mapInArrow(run, "idx long, tokens array<int>")
