"""Dictionary trainers. Both walk their input in order, so each runs as one task: the online pass over a sorted stream that ends when the dictionary is full, byte pairs over the distinct strings.

A dictionary is a list of byte strings, token ids being places in it; the first
256 are the single bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = [bytes([b]) for b in range(256)]
#: Bytes of strings that an online pass is first tried on.
FIRST_BYTES = 16 << 20
#: Token, its halves, and how often the pair was seen when it was merged; nothing for base tokens.
DICTIONARY = "token_id int, token binary, token_len int, left_id int, right_id int, freq long"


class Matcher:
    """Longest token at a place. Tokens are grouped by their first two bytes, so that only lengths that occur there are tried."""

    def __init__(self, tokens: Iterable[bytes] = ()):
        self.ids: dict[bytes, int] = {}
        self.lengths: dict[bytes, list[int]] = {}
        for token_id, token in enumerate(tokens):
            self.add(token, token_id)

    def add(self, token: bytes, token_id: int) -> None:
        self.ids[token] = token_id
        if len(token) > 1:
            sizes = self.lengths.setdefault(token[:2], [])
            if len(token) not in sizes:
                sizes.append(len(token))
                sizes.sort(reverse=True)

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(id, length) of the longest token that data has at a place."""
        for size in self.lengths.get(data[at : at + 2], ()):
            token_id = self.ids.get(data[at : at + size])
            if token_id is not None and at + size <= len(data):
                return token_id, size
        return self.ids[data[at : at + 1]], 1

    def parse(self, data: bytes) -> list[int]:
        """Token ids from the left, the longest at each place."""
        out, at = [], 0
        while at < len(data):
            token_id, size = self.longest(data, at)
            out.append(token_id)
            at += size
        return out


def train_online(strings: Iterable[bytes], threshold: int, max_tokens: int, max_len: int | None = None) -> list[tuple[bytes, int | None, int | None, int | None]]:
    """One pass over the strings: a pair of neighbours seen `threshold` times becomes a token at once.

    Its count starts again, and the new token is the left neighbour of what
    follows. A pair longer than max_len isn't merged. The pass ends when there
    are max_tokens.
    """
    rows: list = [(b, None, None, None) for b in BASE]
    matcher, seen = Matcher(BASE), Counter()
    for data in strings:
        left, at = None, 0
        while at < len(data):
            token_id, size = matcher.longest(data, at)
            merged = False
            if left is not None:
                pair = left[0], token_id
                seen[pair] += 1
                if seen[pair] >= threshold and (max_len is None or left[1] + size <= max_len):
                    token = data[at - left[1] : at + size]
                    rows.append((token, *pair, seen.pop(pair)))
                    matcher.add(token, len(rows) - 1)
                    left, merged = (len(rows) - 1, left[1] + size), True
                    if len(rows) >= max_tokens:
                        return rows
            if not merged:
                left = token_id, size
            at += size
    return rows


def _runs(keys: np.ndarray, at: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places by key: (keys, counts, ends, places), those of keys[k] being places[ends[k] : ends[k + 1]], in order."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(first, len(keys))
    return keys[first], np.diff(ends) if weights is None else np.add.reduceat(weights[at], first), ends, at


def every_second(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places where a token meets its equal, those that don't overlap the one before: every second one of a chain."""
    k = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], at[1:] != after[at[:-1]]]), k, 0))
    return at[(k - first) % 2 == 0]


def train_bpe(strings: Iterable[tuple[bytes, int]], max_tokens: int, min_freq: int = 1) -> list[tuple[bytes, int | None, int | None, int | None]]:
    """Byte-pair encoding over distinct strings with their multiplicities.

    The most frequent pair (the largest ids among equals) is merged everywhere,
    until none has min_freq or there are max_tokens. Overlapping occurrences
    count; merging goes from the left without overlap.

    All of a pair's places come with the newer of its tokens and can only go
    from then on, so a pair is counted again when its last count comes to the
    top of the heap. Pairs of low counts wait in arrays, out of the heap, until
    the counts at its top are as low.
    """
    rows: list = [(b, None, None, None) for b in BASE]
    strings = [(data, n) for data, n in strings if data]
    if not strings or len(rows) >= max_tokens:
        return rows
    # all strings in one line; the place after the last stands for no neighbour
    data = b"".join([data for data, _ in strings])
    sizes, times = np.array([[len(data), n] for data, n in strings], np.int64).T
    size = len(data)
    place = np.int32 if size < (1 << 31) - 1 else np.int64
    ends = np.cumsum(sizes)
    weights = np.repeat(times, sizes) if (times > 1).any() else None
    tokens = np.full(size + 1, -1, np.int32)
    tokens[:size] = np.frombuffer(data, np.uint8)
    after, before = np.arange(1, size + 2, dtype=place), np.arange(-1, size, dtype=place)
    after[ends - 1], before[ends - sizes], after[size] = size, size, size
    del strings, data

    heap, where = [], {}
    waiting: list = []  # (left, right, keys, counts, ends, places): pairs of a token with each of the keys, or, without a token, of the keys' two bytes
    top = low = 1 << 62  # pairs of a count of low or more are in the heap

    def put(group: tuple, most: int) -> None:
        """The pairs of a group with counts from low to below `most` go to the heap; those below wait."""
        left, right, keys, counts, ends, at = group
        some = np.flatnonzero((counts >= low) & (counts < most))
        for key, n, i, j in zip(keys[some].tolist(), counts[some].tolist(), ends[some].tolist(), ends[some + 1].tolist()):
            pair = (left, key) if left is not None else (key, right) if right is not None else (key >> 8, key & 0xFF)
            where[pair] = at[i:j]
            heappush(heap, (-n, -pair[0], -pair[1]))
        if counts.min() < low:
            waiting.append(group)

    at = np.flatnonzero(after[:size] < size).astype(place)
    if len(at):
        put((None, None, *_runs((tokens[at] << 8 | tokens[after[at]]).astype(np.uint16), at, weights)), top)
    while len(rows) < max_tokens:
        while waiting and (not heap or -heap[0][0] < low):
            groups, waiting, above = waiting, [], low
            low = max(1, max(int(g[3].max(initial=0, where=g[3] < above)) for g in groups) // 2)
            for group in groups:
                put(group, above)
        if not heap:
            break
        n, a, b = (-x for x in heappop(heap))
        at = where.pop((a, b))
        at = at[(tokens[at] == a) & (tokens[after[at]] == b)]
        now = len(at) if weights is None else int(weights[at].sum())
        if now != n:  # the entry was out of date
            if now > 0:
                where[a, b] = at
                heappush(heap, (-now, -a, -b))
            continue
        if now < min_freq:
            break
        token = len(rows)
        rows.append((rows[a][0] + rows[b][0], a, b, now))
        if a == b:
            at = every_second(at, after)
        second = after[at]
        right = after[second]
        tokens[at], tokens[second] = token, -1
        after[at], before[right] = right, at
        left = before[at]
        of = tokens[left]
        known = np.flatnonzero((of >= 0) & (of != token))  # two new ones side by side are met from the left
        if len(known):
            put((None, token, *_runs(of[known].astype(np.uint16), left[known], weights)), top)
        of = tokens[right]
        known = np.flatnonzero(of >= 0)
        if len(known):
            put((token, None, *_runs(of[known].astype(np.uint16), at[known], weights)), top)
    return rows


def _table(rows: list) -> pa.Table:
    return pa.table({
        "token_id": pa.array(range(len(rows)), pa.int32()), "token": pa.array([r[0] for r in rows], pa.binary()), "token_len": pa.array([len(r[0]) for r in rows], pa.int32()),
        "left_id": pa.array([r[1] for r in rows], pa.int32()), "right_id": pa.array([r[2] for r in rows], pa.int32()), "freq": pa.array([r[3] for r in rows], pa.int64()),
    })


def online_dictionary(strings: DataFrame, threshold: int, max_tokens: int, max_len: int | None = None, seed: int | None = 42, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """Dictionary (DICTIONARY) of an online pass over (idx, s) in the order of a seeded hash of idx; seed None: in order of idx.

    The pass ends when there are max_tokens, so it needs the strings up to
    there alone: it runs over the first of them by hash, about first_bytes, and
    if these don't fill the dictionary over eight times as many, until they do
    or are all. The dictionary is that of a pass over everything. The task
    reads its strings as a stream that Spark has sorted; it holds the
    dictionary and the counts of pairs.
    """
    place = F.xxhash64(F.lit(seed), "idx") if seed is not None else F.col("idx")
    some = strings.where(F.octet_length("s") > 0).select(place.alias("h"), "idx", F.col("s").cast("binary").alias("b"))
    about = some.agg(F.sum(F.octet_length("b")).alias("size"), F.min("h").alias("low"), F.max("h").alias("high")).first()

    def run(batches):
        each = (x for batch in batches for x in batch.column(2).to_pylist())
        yield from _table(train_online(each, threshold, max_tokens, max_len)).to_batches()

    share = first_bytes / max(1, about["size"] or 0)
    while True:
        part = some if share >= 1 else some.where(F.col("h") <= about["low"] + int(share * (about["high"] - about["low"])))
        rows = part.repartition(1).sortWithinPartitions("h", "idx").mapInArrow(run, DICTIONARY).collect()
        if share >= 1 or len(rows) >= max_tokens:
            break
        share *= 8
    return strings.sparkSession.createDataFrame(rows, DICTIONARY)


def bpe_dictionary(strings: DataFrame, max_tokens: int, min_freq: int = 1) -> DataFrame:
    """Dictionary (DICTIONARY) of byte-pair encoding over (idx, s): equal strings are counted first, in all tasks."""
    distinct = strings.where(F.octet_length("s") > 0).groupBy("s").agg(F.count("*").alias("n")).select(F.col("s").cast("binary").alias("b"), "n")

    def run(table: pa.Table) -> pa.Table:
        return _table(train_bpe(zip(table.column("b").to_pylist(), table.column("n").to_pylist()), max_tokens, min_freq))

    rows = distinct.groupBy(F.lit(0).alias("g")).applyInArrow(run, DICTIONARY).collect()  # trained once, whatever reads it
    # without any string the group doesn't exist; the 256 base tokens stand all the same
    return strings.sparkSession.createDataFrame(rows or _table(train_bpe([], max_tokens)).to_pylist(), DICTIONARY)
