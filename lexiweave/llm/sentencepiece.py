"""Encoding by the pieces of a public vocabulary, and decoding.

A text is cut into units that no piece reaches across. The distinct units make a
lattice: their substrings of bounded length, joined with the piece table, and
grouped by unit. A Viterbi fold over each unit's edges, in the order of their
ends, keeps the best path to every place; the path is then read backwards. The
best path has the largest sum of the pieces' scores; among equals the last
piece is the one of the least id. A character without a piece counts as a piece whose score
is 10 less than the least.

The vocabulary at hand is of byte-pair kind: its scores are the order of its
merges, and its own library joins neighbours in that order, which often is
another segmentation. With order="merges" that one is made instead.
"""

from __future__ import annotations

import json
import mmap
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.serializers import pickle_protocol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.llm._spark import bounded_batches, drop_stored, numbered, stored
from lexiweave.llm._text import _trim as free_memory
from lexiweave.llm._text import bytes_of, pieces_of, trimmed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_SPACE = SPACE.encode()
#: Characters of a chunk of a unit: the lattice and the fold take a longer unit chunk by chunk. An end in it has 6 bits.
CHUNK = 63
#: Units up to which their ids are broadcast (18 bytes each and more for long ones); beyond that, blocks of texts meet their units in a join.
BROADCAST_UNITS = 8_000_000
#: Substrings longer than this are made only where some piece begins with their first so many characters.
PREFIX = 4
#: Bytes of text in a block: the larger it is, the fewer times a unit is sent.
BLOCK = 32 << 20
#: Seed of the units' 64-bit hash.
SEED = 42
#: Bytes of text that a task cuts up at a time, and those whose units it holds.
_SLICE, _HELD = 1 << 20, 64 << 20
#: Distinct units that a task holds, those with their ids, and those whose lattice it makes.
_MET, _KNOWN, _MADE = 500_000, 100_000, 40_000
#: Units that are sent at a time.
_SENT = 1 << 14
#: Bits of an edge, from the lowest: what it stands for, its cost, its size; then its end in the chunk. Of a place in the fold: what its last piece stands for; then the cost.
_WHAT, _COST, _SIZE = 21, 30, 6
#: What a packed pool begins with, and the bytes up to its arrays but for a few that align them.
_MARK, _HEAD = b"lexiweave units\n", 256
_CACHE: dict = {}


class Vocabulary:
    """Pieces, ids and merge order of a SentencePiece model of byte-pair kind."""

    def __init__(self, model: str):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=model)
        size = source.get_piece_size()
        names = [source.id_to_piece(i) for i in range(size)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if source.is_byte(i)}
        self.ids = {names[i]: i for i in range(size) if not (source.is_byte(i) or source.is_control(i) or source.is_unknown(i))}
        self.unknown = source.unk_id()
        self.order = {p: k for k, p in enumerate(sorted(self.ids, key=lambda p: (-source.get_score(self.ids[p]), self.ids[p])))}
        self.longest = max(map(len, self.ids))
        score = {p: source.get_score(i) for p, i in self.ids.items()}
        most, least = max(score.values()), min(score.values())
        #: what pieces cost: how far their scores are from the best, in thousandths (or as fine as fits) unless all are whole numbers
        self.scale = 1 if all(x == int(x) for x in score.values()) else min(1000, ((1 << _COST) - 1) / (max(abs(most), 1) + most - least + 10))
        self.cost = {p: round((most - x) * self.scale) for p, x in score.items()}
        # a path of more pieces has more of what is left out of the costs: it is put back here
        self.each = round(-most * self.scale)
        self.unknown_cost = round((most - least + 10) * self.scale)
        self.size = size
        if self.unknown_cost + self.each >= 1 << _COST or self.longest > CHUNK or size + 0x110000 > 1 << _WHAT:
            raise ValueError(f"{model} doesn't fit: scores {least} to {most}, pieces of {self.longest} characters, {size} ids")
        #: characters of each id's piece
        self.lengths = np.ones(size, np.int64)
        for p, i in self.ids.items():
            self.lengths[i] = len(p)
        # what each id decodes to
        self.surface = [b""] * size
        for p, i in self.ids.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        width = np.fromiter(map(len, self.surface), np.int32, size)
        self.surfaces = np.frombuffer(b"".join(self.surface), np.uint8), np.concatenate([[0], np.cumsum(width)])[:-1].astype(np.int32), width
        self.pattern = self._pattern()

    def _pattern(self) -> str:
        """A pattern whose matches, one after the other, are the units: no piece reaches across two."""
        kinds = {"_": SPACE, "a": "A-Za-z", "d": "0-9", "n": rf"^\x00-\x7f{SPACE}", "r": r"\r", "c": r"\n\t", "p": r"\x00-\x08\x0b\x0c\x0e-/:-@\[-`{-\x7f"}
        tests = {k: re.compile(f"[{c}]") for k, c in kinds.items()}
        kind = {c: next(k for k, t in tests.items() if t.match(c)) for p in self.ids for c in p}
        met = {kind[a] + kind[b] for p in self.ids for a, b in zip(p, p[1:])}
        run = {k: f"[{c}]" + "++" * (k + k in met) for k, c in kinds.items()}
        # a run goes on into a run of another kind where some piece has such neighbours
        on = {k: "|".join(f"[{kinds[j]}]" for j in kinds if j != k and k + j in met) for k in kinds}
        every = "(?:" + "|".join(f"{run[k]}(?={on[k]})" for k in kinds if on[k]) + ")*+(?:" + "|".join(run.values()) + ")"
        #: the kind of each byte of UTF-8, a space standing for U+2581, and which kinds may stand side by side in a unit
        names = list(kinds)
        self.kind_of = np.array([names.index("_" if i == 32 else "n" if i > 127 else next(k for k, t in tests.items() if t.match(chr(i)))) for i in range(256)], np.uint8)
        self.beside = np.array([a + b in met for a in names for b in names + [""] * (8 - len(names))] + [False] * (64 - 8 * len(names)))
        # the common case first, which the general one would match as well: a word of ASCII letters
        lone = f"(?!{on['a']})" if on["a"] else ""
        return (f"{SPACE}*+[A-Za-z]++{lone}|" if {"__", "_a", "aa"} <= met else "") + every

    def units(self, text: str) -> list[str]:
        if "_find" not in self.__dict__:
            self._find = re.compile(self.pattern).findall
        return self._find(SPACE + text.replace(" ", SPACE)) if text else []

    def cut(self, text: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """The units of texts as codes, the distinct ones (U+2581 perhaps as a space), and n+1 offsets by text."""
        data, ends = bytes_of(text)
        ends = ends.astype(np.int64)
        full = np.diff(ends) > 0
        b = np.insert(np.frombuffer(data, np.uint8), ends[:-1][full], 32)  # the space that opens a text
        ends = ends + np.concatenate([[0], np.cumsum(full)])
        if not len(b):
            return np.empty(0, np.int64), [], np.zeros(len(ends), np.int64)
        kind = self.kind_of[b]
        if _SPACE in data:
            at = np.flatnonzero((b[:-2] == _SPACE[0]) & (b[1:-1] == _SPACE[1]) & (b[2:] == _SPACE[2]))
            for k in range(3):
                kind[at + k] = 0
        start = np.ones(len(b), bool)
        start[1:] = ~(self.beside[kind[:-1] * 8 + kind[1:]] | ((b[1:] & 0xC0) == 0x80))
        start[ends[:-1][full]] = True
        at = np.flatnonzero(start)
        flat = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(b)).astype(np.int32)), pa.py_buffer(b)]).dictionary_encode()
        return flat.indices.to_numpy(), flat.dictionary.to_pylist(), np.searchsorted(at, ends)

    def edges(self, unit: str) -> list[tuple[int, int, int]]:
        """(place in the merge order, start, end) of the pieces of two characters or more in a unit."""
        n, order, longest = len(unit), self.order, self.longest
        return sorted((order[s], i, j) for i in range(n) for j in range(i + 2, min(n, i + longest) + 1) if (s := unit[i:j]) in order)

    def fold(self, unit: str) -> list[str]:
        """The pieces of a unit of any length, by merging: the best piece first, and leftmost first among equals, joins two neighbours that it spans."""
        n = len(unit)
        after, before, stands = list(range(1, n + 2)), list(range(-1, n)), [True] * (n + 1)
        for _, i, j in self.edges(unit):
            k = after[i]
            if stands[i] and stands[j] and k < j and after[k] == j:
                stands[k] = False
                after[i], before[j] = j, i
        cuts = [k for k in range(n + 1) if stands[k]]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:])]

    def ids_of(self, pieces: list[str]) -> list[int]:
        """Ids; a character without a piece becomes its bytes, or the unknown."""
        found = [self.ids.get(p) for p in pieces]
        if None not in found:
            return found
        out = []
        for p, i in zip(pieces, found):
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def spelled(self, what: int) -> list[int]:
        """Ids of what a place of the fold stands for: a piece, or a character without one."""
        if what < self.size:
            return [what]
        return [self.bytes[b] for b in chr(what - self.size).encode()] if self.bytes else [self.unknown]

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, the opening space dropped. Bytes that aren't UTF-8 become U+FFFD."""
        out = b"".join(self.surface[i] for i in ids)
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def vocabulary(model: str) -> Vocabulary:
    if model not in _CACHE:
        _CACHE[model] = Vocabulary(model)
    return _CACHE[model]


_UNITS = "unit string, chunk int, h long, h2 long"


def _identity(data: bytes) -> tuple[int, int]:
    """A unit's hashes, the first as a signed long."""
    h = xxhash.xxh64_intdigest(data, SEED)
    return h - (1 << 64) if h >> 63 else h, zlib.crc32(data)


def chunks(unit: str, longest: int) -> list[tuple]:
    """Rows of _UNITS of a unit: itself, or its chunks, each with the characters before it that its pieces may begin at."""
    if len(unit) <= CHUNK:
        return [(unit, 0, None, None)]
    h, h2 = _identity(unit.encode())
    return [(unit[max(0, k * CHUNK - longest) : (k + 1) * CHUNK], k, h, h2) for k in range(-(-len(unit) // CHUNK))]


def distinct_units(texts: DataFrame, model: str, whole: bool = False) -> DataFrame:
    """The distinct units of a column of texts, long ones in chunks (_UNITS) unless they are wanted whole (column unit)."""

    def run(batches):
        words, met, size = vocabulary(model), set(), 0

        def flush():
            while met:
                some = [met.pop().replace(b" ", _SPACE).decode() for _ in range(min(_SENT, len(met)))]
                short = some if whole else [u for u in some if len(u) <= CHUNK]
                if whole:
                    yield pa.record_batch([pa.array(short, pa.string())], names=["unit"])
                    continue
                none = pa.nulls(len(short), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(short, pa.string()), pa.array(np.zeros(len(short), np.int32)), none, none], names=names)
                for u in some:
                    if len(u) > CHUNK:
                        rows = list(zip(*chunks(u, words.longest)))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=names)

        names = ["unit", "chunk", "h", "h2"]
        for batch in pieces_of(batches, 0, _SLICE):
            met.update(words.cut(batch.column(0))[1])
            size += batch.column(0).nbytes
            if len(met) > _MET or size > _HELD:
                yield from flush()
                size = 0
        yield from flush()

    return texts.mapInArrow(trimmed(run), "unit string" if whole else _UNITS).distinct()


def lattice(units: DataFrame, words: Vocabulary, parts: int = 1, chunked: bool = False) -> DataFrame:
    """(h, h2, edges) of the distinct units (_UNITS), and with chunked also chunk: all pieces that end there, packed, in the order of their ends and then sizes.

    Each place has an edge of size 1, be it that of a character without a piece.
    """
    keys = ["h", "h2", *["chunk"] * chunked]
    spark = units.sparkSession
    starts: dict[str, int] = {}  # the longest piece by its first PREFIX characters
    for p in words.order:
        if len(p) >= PREFIX:
            starts[p[:PREFIX]] = max(starts.get(p[:PREFIX], 0), len(p))
    # by hash, as it makes the smaller table: two prefixes of one hash would only make some substrings in vain
    # both from Arrow: a list goes through Python workers of a kind of their own, which stay beside those of the Arrow functions
    reach = spark.createDataFrame(pa.table({"prefix": pa.array(starts.keys(), pa.string()), "reach": pa.array(starts.values(), pa.int32())})).groupBy(F.xxhash64("prefix").alias("prefix")).agg(F.max("reach").alias("reach"))
    worths = [(words.cost[p] + words.each << _WHAT) | i for p, i in words.ids.items()]
    table = spark.createDataFrame(pa.table({"piece": pa.array(words.ids.keys(), pa.string()), "worth": pa.array(worths, pa.int64())})).withColumn("key", F.xxhash64("piece"))
    spans = (
        units.select("unit", "chunk", F.coalesce("h", F.xxhash64("unit")).alias("h"), F.coalesce("h2", F.crc32(F.col("unit").cast("binary"))).alias("h2"))
        .repartition(parts, "h", "h2")
        .withColumn("lead", F.least(F.lit(words.longest), F.col("chunk") * CHUNK)).withColumn("m", F.length("unit"))
        .withColumn("i", F.explode(F.expr("sequence(0, m - 1)")))
        .withColumn("prefix", F.expr(f"xxhash64(substring(unit, i + 1, {PREFIX}))")).join(F.broadcast(reach), "prefix", "left")
        .withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.greatest(F.coalesce("reach", F.lit(0)), F.lit(PREFIX - 1)), F.expr("m - i")))))
        .where("i + size > lead")
        .select(*keys, (F.col("i") + F.col("size") - F.col("lead")).alias("end"), "size", F.expr("substring(unit, i + 1, size)").alias("part"))
        .withColumn("key", F.xxhash64("part"))
    )
    # a long key makes the smaller hash table; the pieces themselves are compared as well
    met = spans.join(F.broadcast(table), ["key"], "left").withColumn("hit", F.coalesce(F.col("part") == F.col("piece"), F.lit(False))).where("hit or size = 1")
    foreign = F.lit(words.unknown_cost + words.each << _WHAT) + words.size + F.ascii("part")
    worth = F.when(F.col("hit"), F.col("worth")).otherwise(foreign)
    edge = F.shiftleft(F.col("end").cast("long"), _WHAT + _COST + _SIZE).bitwiseOR(F.shiftleft(F.col("size").cast("long"), _WHAT + _COST)).bitwiseOR(worth)
    return met.groupBy(*keys).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def best_paths(units: DataFrame, words: Vocabulary) -> DataFrame:
    """(h, h2, places) of the distinct units (_UNITS, a table that may be read twice): for the end of each character the last piece of the best path there, as what it stands for.

    The fold's state is the best cost of each place so far and of the one being
    worked on, each with its last piece; an edge of size 1 opens a place. From
    one chunk to the next it needs as many places as the longest piece has
    characters.
    """
    longest, costs, worth = words.longest, ~((1 << _WHAT) - 1), (1 << _WHAT + _COST) - 1
    size = f"cast(shiftright(e, {_WHAT + _COST}) & {(1 << _SIZE) - 1} as int)"
    # what an edge adds lies in it as a place does: its cost, and what it stands for
    opened = f"named_struct('w', concat(t.w, array(t.cur)), 'cur', (t.cur & {costs}L) + (e & {worth}L))"
    bettered = f"named_struct('w', t.w, 'cur', least(t.cur, (element_at(t.w, -{size}) & {costs}L) + (e & {worth}L)))"
    taken = f"(t.cur & {costs}L)"  # costs are counted from the end of the chunk before
    kept = f"slice(t.w, greatest(1, size(t.w) - {longest - 1}), {longest})"
    ends = f"transform(slice(concat(t.w, array(t.cur)), size(s.w) + 2, {CHUNK}), x -> cast(x & {~costs}L as int))"
    packed = F.expr(f"""aggregate(chunks, named_struct('w', cast(array() as array<bigint>), 'cur', 0L, 'done', cast(array() as array<array<int>>)),
        (s, c) -> aggregate(c.edges, named_struct('w', s.w, 'cur', s.cur), (t, e) -> if({size} = 1, {opened}, {bettered}),
                            t -> named_struct('w', transform({kept}, x -> x - {taken}), 'cur', t.cur - {taken}, 'done', concat(s.done, array({ends})))),
        s -> flatten(s.done))""")
    sizes = units.agg(F.count("*").alias("n"), F.count("h").alias("long")).first()
    short = lattice(units.where("h is null"), words, max(1, sizes["n"] // _MADE)).select("h", "h2", F.array(F.struct("edges")).alias("chunks"))
    if sizes["long"]:
        each = lattice(units.where("h is not null"), words, max(1, sizes["long"] * CHUNK // _MADE), chunked=True)
        ordered = each.groupBy("h", "h2").agg(F.sort_array(F.collect_list(F.struct("chunk", "edges"))).alias("chunks"))
        short = short.unionByName(ordered.select("h", "h2", F.transform("chunks", lambda c: F.struct(c["edges"].alias("edges"))).alias("chunks")))
    return short.select("h", "h2", packed.alias("places"))


def traced(paths: DataFrame, model: str) -> DataFrame:
    """(h, h2, ids) of best paths, read backwards: the last pieces of all units of a batch, then those before them, and so on."""

    def run(batches):
        words = vocabulary(model)
        known, length = words.size, np.append(words.lengths, 1)
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            sizes = length[np.minimum(flat, known)]
            live, at = np.arange(batch.num_rows), ends[1:].copy()
            taken = []  # (units, ids) from the last pieces on
            count = np.zeros(batch.num_rows, np.int64)
            while len(live):
                here = at[live] - 1
                taken.append((live, flat[here]))
                count[live] += 1
                at[live] -= sizes[here]
                live = live[at[live] > ends[live]]
            stops = np.concatenate([[0], np.cumsum(count)])
            out = np.empty(int(stops[-1]), np.int64)
            for k, (units, pieces) in enumerate(taken):
                out[stops[units + 1] - 1 - k] = pieces
            foreign = np.flatnonzero(out >= known)
            if len(foreign):
                spelled = [words.spelled(i) for i in out[foreign].tolist()]
                more = np.ones(len(out), np.int64)
                more[foreign] = [len(x) for x in spelled]
                first = np.cumsum(more) - more
                whole = np.empty(int(more.sum()), np.int64)
                plain = np.flatnonzero(out < known)
                whole[first[plain]] = out[plain]
                for i, x in zip(first[foreign].tolist(), spelled):
                    whole[i : i + len(x)] = x
                stops, out = np.concatenate([[0], np.cumsum(more)])[stops], whole
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(out.astype(np.int32)))], names=["h", "h2", "ids"])

    return paths.mapInArrow(trimmed(run), "h long, h2 long, ids array<int>")


def merged(units: DataFrame, model: str) -> DataFrame:
    """(h, h2, ids) of distinct units by merging, as the library of a byte-pair vocabulary does."""

    def run(batches):
        words = vocabulary(model)
        for batch in pieces_of(batches, 0, _SLICE):
            units = batch.column(0).to_pylist()
            h, h2 = zip(*(_identity(u.encode()) for u in units))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(h2, pa.int64()), pa.array([words.ids_of(words.fold(u)) for u in units], pa.list_(pa.int32()))], names=["h", "h2", "ids"])

    return units.mapInArrow(trimmed(run), "h long, h2 long, ids array<int>")


_ADDED = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]


class Known(dict):
    """Numbers of units, given as they come, and their ids in one pool."""

    def __init__(self, words: Vocabulary, ids_of):
        """ids_of(units) gives the sizes of their ids, and these one after the other."""
        super().__init__()
        self.words, self.ids_of, self.new = words, ids_of, []
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.room, self.sizes, self.pool = 0, np.empty(0, np.int32), np.empty(0, np.int32)

    def __missing__(self, unit: bytes) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        self.room += len(unit)
        return number

    def codes(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all units of the texts, and n+1 offsets by text. Forgets what it knew when that is too much."""
        if len(self) > _KNOWN or self.room > _HELD // 2:
            self._forget()
        codes, distinct, ends = self.words.cut(text)
        number = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        if self.new:
            sizes, ids = self.ids_of([u.replace(b" ", _SPACE) for u in self.new])
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
            self.new.clear()
        return number[codes], ends


class _Place:
    """A file that keeps nothing but where the mark of a packed pool is in it."""

    def __init__(self):
        self.at, self.size = 0, 0

    def write(self, data) -> None:
        at = bytes(memoryview(data)[:4096]).find(_MARK)
        if at >= 0:
            self.at = self.size + at
        self.size += len(data)


class Pool:
    """Ids of units by hash: keys sorted, and where in one pool each one's ids are."""

    def __init__(self, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray):
        self.keys, self.starts, self.sizes, self.pool = keys, starts, sizes, pool

    @classmethod
    def of(cls, table: pa.Table) -> Pool:
        h, lists = table.column("h").to_numpy().view(np.uint64), table.column("ids").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        order = np.argsort(h)
        ends = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
        flat = lists.flatten().to_numpy()
        sizes = np.diff(ends)
        starts = ends[:-1][order].astype(np.uint32 if len(flat) < 1 << 32 else np.int64)
        pool = flat.astype(np.uint16) if not len(flat) or flat.max() < 1 << 16 else flat
        return cls(h[order], starts, sizes[order].astype(np.min_scalar_type(sizes.max(initial=0))), pool)

    def packed(self) -> bytearray:
        """The pool to broadcast: in the file that Spark makes of it each array begins at a multiple of 8 bytes, so that it can be used where it lies."""
        arrays = self.keys, self.starts, self.sizes, self.pool
        out = bytearray(_HEAD + 8 + sum(-(-a.nbytes // 8) * 8 for a in arrays))
        out[: len(_MARK)] = _MARK
        pickle.dump(out, place := _Place(), pickle_protocol)
        gap = -(place.at + _HEAD) % 8
        out[:_HEAD] = (_MARK + json.dumps([gap, [(a.dtype.str, len(a)) for a in arrays]]).encode()).ljust(_HEAD)
        at = _HEAD + gap
        for a in arrays:
            np.frombuffer(out, a.dtype, len(a), at)[:] = a
            at += -(-a.nbytes // 8) * 8
        return out

    @classmethod
    def unpacked(cls, data, at: int = 0) -> Pool:
        """The pool whose mark is at this place of data, which stays in use. Arrays that aren't aligned are copied."""
        gap, kinds = json.loads(bytes(data[at + len(_MARK) : at + _HEAD]))
        at += _HEAD + gap
        arrays = []
        for kind, n in kinds:
            a = np.frombuffer(data, kind, n, at)
            arrays.append(a if a.flags.aligned else a.copy())
            at += -(-a.nbytes // 8) * 8
        return cls(*arrays)

    @classmethod
    def shared(cls, table: Broadcast) -> Pool:
        """A packed pool that was broadcast, mapped from the file that Spark has of it here: an executor's workers share its pages. A copy where there is no plain file (encryption)."""
        path = getattr(table, "_path", None)
        if path:
            try:
                with open(path, "rb") as f:
                    data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            except (OSError, ValueError):
                return cls.unpacked(table.value)
            at = data.find(_MARK, 0, 4096)
            if at >= 0:
                return cls.unpacked(data, at)
        return cls.unpacked(table.value)

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(u, SEED) for u in units), np.uint64, len(units))
        at = np.searchsorted(self.keys, h)
        if len(units) and (not len(self.keys) or (self.keys[np.minimum(at, len(self.keys) - 1)] != h).any()):
            raise ValueError("a text has a unit that it did not have when the units were collected")
        sizes = self.sizes[at].astype(np.int32)
        ends = np.cumsum(sizes)
        return sizes, self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int32)


def _pack(known: Known, text: pa.Array) -> list[pa.Array]:
    """Columns ids and decoded of the texts of a slice, which is far below 2 GB."""
    codes, ends_of_rows = known.codes(text)
    starts = (np.cumsum(known.sizes) - known.sizes).astype(np.int32)
    length = known.sizes[codes]
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    flat = known.pool[np.repeat(starts[codes] - ends[:-1], length) + np.arange(ends[-1], dtype=np.int32)]
    rows = ends[ends_of_rows]
    # decoding goes through the ids alone
    surface, at, width = known.words.surfaces
    w = width[flat]
    stop = np.concatenate([[0], np.cumsum(w)]).astype(np.int32)
    data = surface[np.repeat(at[flat] - stop[:-1], w) + np.arange(stop[-1], dtype=np.int32)].tobytes()
    edge = stop[rows].tolist()
    decoded = [(s[1:] if s[:1] == b" " else s).decode("utf-8", "replace") for s in (data[a:b] for a, b in zip(edge, edge[1:]))]
    return [pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(flat)), pa.array(decoded, pa.string())]


def encode(docs: DataFrame, text: str = "text", model: str = VOCABULARY, order: str = "scores", broadcast_units: int = BROADCAST_UNITS) -> DataFrame:
    """docs with columns ids and decoded added (or replaced, if docs has such columns).

    ids (array of int) are the path of the best sum of scores, without special
    tokens, or, with order="merges", the segmentation of a byte-pair
    vocabulary's own library; characters that the vocabulary lacks become
    bytes. decoded is made from ids alone: the text again, with U+2581 become a
    space. Null and empty texts have no ids and decode to the empty text.
    Repeated rows are encoded alike; other columns stay; an empty table gives no
    rows.
    """
    if order not in ("scores", "merges"):
        raise ValueError(f"order is scores or merges, not {order!r}")
    bounded_batches(docs.sparkSession)
    words = vocabulary(model)
    own = [c for c in docs.columns if c not in ("ids", "decoded")]
    at = own.index(text)
    schema = T.StructType([*[docs.schema[c] for c in own], *_ADDED])
    base = docs.select(*[F.col(f"`{c}`") for c in own])
    texts = docs.select(F.col(f"`{text}`"))
    if order == "scores":
        units = stored(distinct_units(texts, model))
        known = stored(traced(best_paths(units, words), model))
        drop_stored(units)
    else:
        known = stored(merged(distinct_units(texts, model, whole=True), model))
    context = docs.sparkSession.sparkContext
    if known.count() <= broadcast_units:
        pool = Pool.of(known.select("h", "ids").toArrow())
        free_memory()  # of the table, before the pool is there twice
        table = context.broadcast(pool.packed())
        drop_stored(known)

        def run(batches):
            met = Known(vocabulary(model), Pool.shared(table))
            for batch in pieces_of(batches, at, _SLICE):
                yield pa.RecordBatch.from_arrays([*batch.columns, *_pack(met, batch.column(at))], names=[*own, "ids", "decoded"])

        return base.mapInArrow(trimmed(run), schema)

    def dealt(batches):
        for block, batch in numbered(batches, at, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, own), batch.column(at), pa.array(np.full(batch.num_rows, block))], names=["row", "text", "block"])

    def asked_of(batches):
        words = vocabulary(model)
        for batch in pieces_of(batches, 1, _SLICE):
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in zip(cuts, cuts[1:]):
                found = [_identity(u.replace(b" ", _SPACE)) for u in words.cut(batch.column(1).slice(i, j - i))[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), numbers[i])), pa.array([h for h, _ in found], pa.int64()), pa.array([h for _, h in found], pa.int64())], names=["block", "h", "h2"])

    row = T.StructType([docs.schema[c] for c in own])
    blocks = stored(base.mapInArrow(dealt, T.StructType([T.StructField("row", row), T.StructField("text", T.StringType()), T.StructField("block", T.LongType())])))
    # a unit comes once for each block that has it, so no unit has more rows than there are blocks
    asked = blocks.select("block", "text").mapInArrow(asked_of, "block long, h long, h2 long").distinct()
    met = asked.join(known, ["h", "h2"]).select("block", "h", "ids")

    def run_joined(left: pa.Table, right: pa.Table) -> pa.Table:
        met, out = Known(vocabulary(model), Pool.of(right)), []
        for batch in left.combine_chunks().to_batches():
            for part in pieces_of([batch], 1, _SLICE):
                out.append(pa.RecordBatch.from_arrays([*part.column(0).flatten(), *_pack(met, part.column(1))], names=[*own, "ids", "decoded"]))
        return pa.Table.from_batches(out)

    return blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(run_joined, schema)
