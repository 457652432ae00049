"""Benchmark passages in documents, by Wu-Manber search over words.

The windows of all benchmark items are the patterns. For each pattern length a
table of block shifts (a block is two consecutive words) says how far the search
may move on; where the shift is zero, the block's bucket names the patterns that
end with it, and these are compared word by word.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.llm._spark import bounded_batches, by_place
from lexiweave.llm._text import LOWER_ALNUM, pieces_of

WINDOW = 10
#: Most patterns of one searcher; more are dealt to several, one after the other.
BLOCK = 200_000
#: Bytes of benchmark text that come to the driver at a time.
SLAB = 32 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_ALNUM).split()


class Searcher:
    """Patterns of one length, each with the items that it comes from."""

    def __init__(self, patterns: dict[tuple, set]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.default = self.length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = self._key(words, end - 1)
                self.shift[key] = min(self.shift.get(key, self.default), self.length - end)
            self.buckets[self._key(words, self.length - 1)].append((list(words), _ordered(items)))
        self.buckets = dict(self.buckets)

    def _key(self, words, end: int):
        return words[end] if self.block == 1 else (words[end - 1], words[end])

    def search(self, words: list[bytes], starts: list[int], items: set) -> None:
        """Appends the places where a pattern starts, and adds the items."""
        n, m, default, shift, buckets = len(words), self.length, self.default, self.shift, self.buckets
        at = m - 1
        if self.block == 2:
            while at < n:
                step = shift.get((words[at - 1], words[at]), default)
                if step:
                    at += step
                    continue
                for pattern, of in buckets[words[at - 1], words[at]]:
                    if words[at - m + 1 : at + 1] == pattern:
                        starts.append(at - m + 1)
                        items.update(of)
                at += 1
        else:
            for at, word in enumerate(words):
                if word in buckets:
                    starts.append(at)
                    for _, of in buckets[word]:
                        items.update(of)


def searchers(rows, window: int, block: int) -> list[list[Searcher]]:
    """Searchers for each block of patterns, by length. rows: (item_id, text)."""
    patterns: dict[tuple, set] = defaultdict(set)
    for item, text in rows:
        words = words_of(text.encode() if isinstance(text, str) else text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            patterns[tuple(words[i : i + window])].add(None if item is None else str(item))
    every, out = list(patterns.items()), []
    for i in range(0, len(every), block):
        by_length = defaultdict(dict)
        for words, items in every[i : i + block]:
            by_length[len(words)][words] = items
        out.append([Searcher(by_length[k]) for k in sorted(by_length)])
    return out


def _ordered(items) -> list:
    """As strings, no id last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """docs with columns n_words, n_hit, item_ids and spans added (or replaced, if docs has such columns).

    Words are runs of ASCII letters and digits and of all non-ASCII, A-Z in
    lower case. A window is `window` consecutive words of an item; an item of
    fewer words, but not none, is one window. A document's word inside any
    occurrence of a window is hit: n_hit counts these words, spans are the runs
    of them (start, end), item_ids the items with an occurring window, sorted as
    strings. Null texts have no words. Items that are null or without words
    count for nothing; items without an id are one item, whose id is null and
    comes last; repeated items are one; with no items nothing is hit. Other
    columns of docs stay; an empty table gives no rows.

    The benchmark comes to the driver in slabs of about `slab` bytes of text, by
    hash, one after the other; a slab's patterns are dealt into searchers of at
    most `block` patterns, each broadcast. So a worker's memory for one of them
    is bounded, and the driver's for a slab; the rows stream through one
    searcher after the other without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    slabs = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slab))
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "item_ids", "spans")]
    at = own.index(text)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = [T.StructField("__spans", T.ArrayType(span)), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())]
    base = T.StructType([docs.schema[c] for c in own])
    out = docs.select(*[F.col(f"`{c}`") for c in own])
    context = docs.sparkSession.sparkContext
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    final = [added[2], T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))]
    groups = []
    for k in range(slabs):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(slabs)) == k) if slabs > 1 else items
        groups += [context.broadcast(group) for group in searchers(mine.toLocalIterator(), window, block)]
    groups = groups or [context.broadcast([])]
    for k, shared in enumerate(groups):
        last = k == len(groups) - 1
        then = final if last else added

        def run(batches, k=k, shared=shared, last=last, then=then):
            group = shared.value
            for batch in pieces_of(batches, at):
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                spans, items, totals = [], [], []
                for i, x in enumerate(texts):
                    words = words_of(x)
                    found: set = set()
                    marks: list[tuple[int, int]] = []
                    for s in group:
                        starts: list[int] = []
                        s.search(words, starts, found)
                        marks += [(a, a + s.length) for a in starts]
                    if k:
                        marks += [(r["start"], r["end"]) for r in batch.column(len(own))[i].as_py()]
                        found.update(batch.column(len(own) + 1)[i].as_py())
                    joined: list[list[int]] = []
                    for a, b in sorted(marks):
                        if joined and a <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], b)
                        else:
                            joined.append([a, b])
                    spans.append([{"start": a, "end": b} for a, b in joined])
                    items.append(_ordered(found))
                    totals.append(len(words))
                places, total, names = pa.array(spans, pa.list_(pair)), pa.array(totals, pa.int64()), pa.array(items, pa.list_(pa.string()))
                if last:
                    new = [total, pa.array([sum(r["end"] - r["start"] for r in x) for x in spans], pa.int64()), names, places]
                else:
                    new = [places, names, total]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *new], names=[*own, *(f.name for f in then)])

        out = out.mapInArrow(run, T.StructType([*base.fields, *then]))

    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs without any window of the benchmark; all columns stay."""
    placed, of = by_place(docs)
    return find(placed, benchmark, of[text], **options).where("n_hit = 0").select(*of.values()).toDF(*docs.columns)
