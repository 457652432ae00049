"""Removal of passages that repeat an earlier one: windows of consecutive words.

First pass: each partition counts its windows in a count-min sketch; the merged
sketch overestimates, never underestimates. Second pass: only windows estimated
to occur twice or more are grouped by 128 bits of hash, which finds each
window's first occurrence exactly.

A window is counted under its minimizer, the least-hashed run of 10 of its
words: equal windows have equal minimizers, at different places if the windows
start at different places, so a minimizer is counted at least as often as any
window that has it, and far fewer cells are needed.
"""

from __future__ import annotations

import zlib
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.llm._spark import bounded_batches, stored
from lexiweave.llm._text import coded, pieces_of, split_words, trimmed

WINDOW = 20
_MULTIPLIER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MOD = 1 << 64
_INVERSE = tuple(pow(m, -1, _MOD) for m in _MULTIPLIER)
#: Bytes of text that a task hashes at a time: a word takes about a hundred bytes meanwhile.
_SLICE = 1 << 20
#: Odd factors of the sketch's rows.
_ROWS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_CHUNK = 20
#: A minimizer is hot if it is one place in so many of a task's; how many lists of hot ones are merged apart.
HOT = 4000
_CHUNKS_OF_HOT = 8
_HOT_LINE = -1
_LAST = np.uint64(_MOD - 1)


class Words:
    """Hashes of the words of a batch, and of any run of them."""

    def __init__(self, text: pa.Array):
        flat, self.offsets = split_words(text)
        codes, distinct = coded(flat)
        self.n = len(codes)
        self.ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        digest = xxhash.xxh3_128_intdigest
        whole = [digest(w) for w in distinct]
        self._hash = [np.array([h & (_MOD - 1) for h in whole], np.uint64), np.array([h >> 64 for h in whole], np.uint64)]
        self._codes = codes
        self._sums: dict[int, tuple] = {}

    def runs(self, length: int, half: int = 0) -> np.ndarray:
        """A polynomial hash, modulo 2**64, of the `length` words from each place; ends of rows aren't minded."""
        if half not in self._sums:
            powers = np.multiply.accumulate(np.full(self.n, _MULTIPLIER[half], np.uint64))
            back = np.multiply.accumulate(np.full(self.n, _INVERSE[half], np.uint64))
            self._sums[half] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._hash[half][self._codes] * powers, dtype=np.uint64)]), back
        sums, back = self._sums[half]
        out = np.zeros(self.n, np.uint64)
        k = max(0, self.n - length + 1)
        out[:k] = (sums[length : length + k] - sums[:k]) * back[:k]
        return out

    def starts(self, length: int) -> np.ndarray:
        """Whether a run of `length` words of one row starts at each place."""
        return self.ends - np.arange(self.n) >= length


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width]; beyond the end, over what there is."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = best(out[: len(out) - step], out[step:])
        have += step
    return out


def minimizers(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's minimizer hash, whether a window starts there, and the hashes at the places that are some window's minimizer."""
    gram = max(1, window // 2)
    width = window - gram + 1
    starts = words.starts(window)
    grams = np.where(words.starts(gram), words.runs(gram) * np.uint64(_ROWS[0]), _LAST)
    if not words.n:
        return grams, starts, grams
    least = _sliding(grams, width, np.minimum)
    of_starts = np.where(starts, least, np.uint64(0))
    reach = _sliding(of_starts[::-1], width, np.maximum)[::-1]
    return least, starts, grams[(reach == grams) & words.starts(gram)]


def cells(keys: np.ndarray, bits: int, row: int) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(29))) * np.uint64(_ROWS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(text_bytes: int) -> int:
    """Cells in a row of the sketch, as a power of two: three or more for each counted place, 2**29 at most.

    Beyond that the sketch lets more windows through to the exact grouping.
    """
    return min(29, max(16, ceil(log2(max(1, text_bytes) / 12))))


_SKETCH_NAMES = ["line", "chunk", "part", "once", "twice"]
#: Sketches of about so many bytes of text each meet in one task at a time: so many of them.
_FANNED, _FAN = 16 << 20, 64


def repeated_cells(docs: DataFrame, text: str, window: int, bits: int, text_bytes: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row of the merged sketch, the bitmap of cells that count two or more: 2**bits / 8 bytes each.

    And the hot minimizers, at most _CHUNKS_OF_HOT * HOT, the most frequent.
    """

    step = 1 << min(_CHUNK, bits)

    def partial(keys):
        """The sketch of some places, by chunks of cells that aren't empty."""
        number = TaskContext.get().partitionId()
        for row in range(len(_ROWS)):
            at, k = np.unique(cells(keys, bits, row), return_counts=True)
            edges = np.searchsorted(at, np.arange(0, (1 << bits) + 1, step))
            for chunk, (i, j) in enumerate(zip(edges, edges[1:])):
                if i < j:
                    part = np.zeros(step, np.uint8)
                    part[at[i:j] - chunk * step] = np.minimum(k[i:j], 2)
                    packed = [zlib.compress(np.packbits(part == n).tobytes(), 1) for n in (1, 2)]
                    yield pa.record_batch([pa.array([row], pa.int32()), pa.array([chunk], pa.int32()), pa.array([number]), pa.array([packed[0]]), pa.array([packed[1]])], names=_SKETCH_NAMES)
        found, n = np.unique(keys, return_counts=True)
        often = n >= max(64, len(keys) // HOT)
        found, n = found[often], n[often]
        for chunk in range(_CHUNKS_OF_HOT):
            mine = found % np.uint64(_CHUNKS_OF_HOT) == chunk
            if mine.any():
                yield pa.record_batch([pa.array([_HOT_LINE], pa.int32()), pa.array([chunk], pa.int32()), pa.array([number]), pa.array([found[mine].tobytes()]), pa.array([n[mine].tobytes()])], names=_SKETCH_NAMES)

    def count(batches):
        held, n = [], 0
        for batch in pieces_of(batches, limit=_SLICE):
            held.append(minimizers(Words(batch.column(0)), window)[2])
            n += len(held[-1])
            if n >= 2 * _HELD:
                yield from partial(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from partial(np.concatenate(held))

    def merge(table: pa.Table) -> pa.Table:
        line, chunk, salt = (table.column(c)[0].as_py() for c in ("line", "chunk", "salt"))
        parts = zip(table.column("once").to_pylist(), table.column("twice").to_pylist())
        if line == _HOT_LINE:
            held = list(parts)
            found, at = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x, _ in held]), return_inverse=True)
            n = np.zeros(len(found), np.int64)
            np.add.at(n, at, np.concatenate([np.frombuffer(x, np.int64) for _, x in held]))
            most = np.argsort(-n, kind="stable")[: HOT if salt == 0 else 4 * HOT]
            packed = found[most].tobytes(), n[most].tobytes()
        else:
            once = twice = None
            for pair in parts:
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in pair)
                twice = b if once is None else twice | b | (once & a)
                once = a if once is None else once | a
            packed = tuple(zlib.compress(x.tobytes(), 1) for x in (once, twice))
        return pa.table({"line": pa.array([line], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "part": pa.array([salt], pa.int64()), "once": [packed[0]], "twice": [packed[1]]})

    columns = "line int, chunk int, part long, once binary, twice binary"
    merged = docs.select(text).mapInArrow(trimmed(count), columns)
    # the sketches of some _FAN * _FANNED bytes of text meet at a time, so a task holds as much of a chunk whatever there is in all
    parts = max(1, text_bytes // _FANNED)
    while True:
        parts = -(-parts // _FAN)
        merged = merged.withColumn("salt", F.pmod("part", F.lit(parts)).cast("int")).groupBy("line", "chunk", "salt").applyInArrow(merge, columns)
        if parts == 1:
            break
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in _ROWS]
    hot = [np.empty(0, np.uint64)]
    for r in stored(merged).toLocalIterator():
        if r["line"] == _HOT_LINE:
            hot.append(np.frombuffer(bytes(r["once"]), np.uint64))
            continue
        out[r["line"]][(r["chunk"] * step) >> 3 : ((r["chunk"] + 1) * step) >> 3] = np.frombuffer(zlib.decompress(bytes(r["twice"])), np.uint8)
    return out, np.sort(np.concatenate(hot))


#: Rows of candidate windows that a task holds before it sorts and sends them; in so many parts, and so many rows at a time.
_HELD = 1 << 20
_SORTED, _SENT = 8, 1 << 16
#: A run of consecutive candidate starts of one row that share a minimizer (its hash is `gram`), with the windows' hashes.
#: A window is known by both hashes, 128 bits. `at` is the first start. Runs of starts that are known to be later have no
#: hashes but their length in the upper half of `at`, and any gram.
_FOUND = "gram long, __id long, __tk long, at long, windows array<long>"
_FOUND_NAMES = ["gram", "__id", "__tk", "at", "windows"]
#: Null ids sort last.
_NONE = (1 << 63) - 1


def _edges(*columns) -> np.ndarray:
    """Where runs begin, and the end: of equal values, and in the last column of consecutive ones."""
    first = np.ones(len(columns[-1]), bool)
    first[1:] = columns[-1][1:] != columns[-1][:-1] + 1
    for c in columns[:-1]:
        first[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(first), len(first))


def columns_of(held: list[list]) -> list[np.ndarray]:
    """The columns of what a task holds, each in one piece; empties it, so that no more than a column is there twice."""
    out = []
    while held[0]:
        out.append(np.concatenate([x.pop(0) for x in held]))
    held.clear()
    return out


def first_ones(grams: np.ndarray, hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each window is the earliest of its words; rows that share an id may tie. Sorts a part of the minimizers at a time."""
    earliest = np.empty(len(grams), bool)
    part = (grams * np.uint64(_ROWS[1]) >> np.uint64(56)).astype(np.uint8) % _SORTED
    for p in range(_SORTED):
        mine = np.flatnonzero(part == p)
        g, h, i, s = (x[mine] for x in (grams, hashes, ids, starts))
        order = np.lexsort((s, i, h, g))
        new = np.ones(len(order), bool)
        new[1:] = (g[order[1:]] != g[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        earliest[mine[order]] = (i[order] == i[lead]) & (s[order] == s[lead])
    return earliest


def sent(at: np.ndarray):
    """Places, _SENT at a time."""
    for a in range(0, len(at), _SENT):
        yield at[a : a + _SENT]


def _found_in(held: list[list], hot: np.ndarray):
    """Batches of _FOUND of the windows that a task holds (hash of the minimizer, of the window, id, key, start): the earliest of each, and the others as runs."""
    grams, hashes, ids, keys, starts = columns_of(held)
    earliest = first_ones(grams, hashes, ids, starts)
    # in the order of the rows, in which starts are consecutive; a run that goes on beyond what is sent at a time goes as two
    for at in sent(np.flatnonzero(earliest)):
        g, h, i, k, s = (x[at] for x in (grams, hashes, ids, keys, starts))
        # a minimizer that is in many places may have more windows than a task should hold: its windows go each for itself
        g = np.where(np.isin(g, hot), (g ^ (h >> np.uint64(1))) * np.uint64(_ROWS[1]), g)
        ends = _edges(g, i, k, s)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
        at = ends[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(i[at]), pa.array(k[at]), pa.array(s[at].astype(np.int64)), lists], names=_FOUND_NAMES)
    for at in sent(np.flatnonzero(~earliest)):
        i, k, s = (x[at] for x in (ids, keys, starts))
        edges = _edges(i, k, s)
        at = edges[:-1]
        s = s[at].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(i[at] * np.int64(_INVERSE[0] >> 1) + s), pa.array(i[at]), pa.array(k[at]), pa.array(s + (np.diff(edges).astype(np.int64) << 32)), pa.nulls(len(at), pa.list_(pa.int64()))], names=_FOUND_NAMES)


def _candidates(docs: DataFrame, window: int, bits: int, twice) -> DataFrame:
    """Windows estimated to be repeated: the earliest of each in its task's block, and the others as runs."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches):
        held, n = [], 0
        maps, hot = shared.value
        for batch in pieces_of(batches, 2, _SLICE):
            words = Words(batch.column(2))
            least, starts, _ = minimizers(words, window)
            at = np.flatnonzero(starts)
            for row, bitmap in enumerate(maps):
                cell = cells(least[at], bits, row)
                at = at[(bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0]
            if len(at):
                row = np.searchsorted(words.offsets, at, side="right") - 1
                ids, keys = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
                held.append([least[at], words.runs(window, 1)[at], ids, keys, (at - words.offsets[row]).astype(np.int32)])
                n += len(at)
                if n >= _HELD:
                    yield from _found_in(held, hot)
                    n = 0
        if held:
            yield from _found_in(held, hot)

    return docs.select("__id", "__tk", "__text").mapInArrow(trimmed(run), _FOUND)


def later_starts(docs: DataFrame, window: int, bits: int | None = None) -> DataFrame:
    """(__id, __tk, start, run): runs of starts of windows whose words start earlier elsewhere. docs has __id, __tk, __text."""
    size = docs.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    bits = bits or sketch_bits(size)
    found = _candidates(docs, window, bits, repeated_cells(docs, "__text", window, bits, size))
    # a block sends a window once, so a key has at most as many rows as there are blocks (and rows that share an id);
    # the windows of a run stay together until they have met those of their minimizer
    each = found.repartition("gram").select("gram", "__id", "__tk", "at", F.posexplode_outer("windows").alias("k", "window"))
    run = F.shiftright("at", 32).cast("int")
    each = each.select("gram", "window", "__id", "__tk", (F.col("at").bitwiseAND(F.lit((1 << 32) - 1)) + F.coalesce("k", F.lit(0))).cast("int").alias("start"), run.alias("run"))
    order = F.struct("__id", "start")
    first = F.min(F.when(F.col("run") == 0, order)).over(Window.partitionBy("gram", "window"))
    late = each.withColumn("first", first).where((F.col("run") > 0) | (order > F.col("first")))
    return late.select("__id", "__tk", "start", F.greatest("run", F.lit(1)).alias("run"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """docs with columns n_words, n_removed and kept_text added (or replaced, if docs has such columns).

    Words are runs of anything but ASCII white space. Each word that is covered
    by a window of `window` words whose words also start earlier, in a row of a
    smaller id or earlier in the same, is removed; windows are judged on the
    input. kept_text joins the other words by one space. Null texts have no
    words; texts shorter than a window lose nothing. Ids are integers; a null
    id is later than any other; rows that share an id are one document to the
    comparison, so repeated rows don't remove each other's words. Other columns
    stay. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))
    shared = docs.select(ident.alias("i")).groupBy("i").count().where("count > 1").limit(1).count()
    # where ids are shared, the text tells the rows apart
    key = F.xxhash64(text) if shared else F.lit(0).cast("long")
    base = docs.select(ident.alias("__id"), key.alias("__tk"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"))
    late = later_starts(base.select("__id", "__tk", F.col(f"__row.`{text}`").alias("__text")), window, bits)
    if shared:  # rows of one id and text have the same starts: once is enough
        late = late.distinct()
    gone = late.groupBy("__id", "__tk").agg(F.collect_list(F.struct("start", "run")).alias("__gone"))
    joined = base.join(gone, ["__id", "__tk"], "left").select("__gone", "__row")
    at = own.index(text) + 1
    schema = T.StructType([*base.schema["__row"].dataType.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def unpacked(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.column(1).flatten()], names=["__gone", *own])

    def cut(batches):
        for batch in pieces_of(unpacked(batches), at):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            gone = batch.column(0)
            total, removed, kept = [], [], []
            for i, x in enumerate(texts):
                words = (x or b"").split()
                total.append(len(words))
                if gone[i].is_valid and len(gone[i].values):
                    flat = gone[i].values
                    a = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    b = a + flat.field(1).to_numpy(zero_copy_only=False) + window - 1
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            extra = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *extra], names=[f.name for f in schema.fields])

    return joined.mapInArrow(trimmed(cut), schema)
