"""Hidden Markov language model: exact likelihoods of texts by the scaled forward recursion.

Tokens are the lower-case words and one end of the text. The states emit
symbols: every word seen OWN_LEAST times or more by itself, rarer words by
classes of equal order of frequency, unknown words as one class. Within its
class a word has a fixed share. The states start from classes of the most
frequent words, told apart by their neighbours in all training texts;
Baum-Welch then sums its expected counts over whole training texts, partition
by partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.llm._spark import bounded_batches, drop_stored, numbered, stored
from lexiweave.llm._text import LOWER
from lexiweave.llm._text import _trim as free_memory
from lexiweave.llm._text import coded, pieces_of, split_words, trimmed

STATES = 16
#: Least occurrences of a word with a symbol of its own; a power of two.
OWN_LEAST = 8
#: Passes of Baum-Welch over all training texts.
PASSES = 3
#: Most frequent words whose neighbours part the states at the start.
HEAD = 512
#: Distinct words up to which counts are broadcast (8 bytes a rare word, 16 another); beyond that, blocks of texts meet their words' counts in a join.
BROADCAST_WORDS = 8_000_000
#: Words with a symbol up to which emissions are broadcast (64 bytes each); beyond that, blocks of texts meet their symbols' emissions in a join.
BROADCAST_OWN = 1_000_000
#: Bytes of text in a block: the larger it is, the fewer times a word is sent.
BLOCK = 32 << 20
ADDED = 0.1
#: Symbols that aren't words: rare words by order of frequency, then unknown words. Words' own symbols follow, the most frequent first.
_RARE = OWN_LEAST.bit_length() - 1
_UNKNOWN = _RARE
_CLASSES = _RARE + 1
#: Tokens that a task works on at once, those whose states' probabilities it holds meanwhile, and those that it takes counts of.
_TOKENS, _SEGMENT, _PART = 1 << 20, 1 << 20, 1 << 17
_END = b""


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 10 == 0, F.lit(False))


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all texts (first column), ends of texts as the empty word."""

    def count(batches):
        held: dict[bytes, int] = {}

        def flush():
            words, n = list(held), list(held.values())
            held.clear()
            for i in range(0, len(words), 1 << 16):
                yield pa.record_batch([pa.array(words[i : i + (1 << 16)], pa.binary()), pa.array(n[i : i + (1 << 16)], pa.int64())], names=["word", "n"])

        for batch in pieces_of(batches):
            codes, distinct = coded(split_words(batch.column(0), LOWER)[0])
            for word, n in zip(distinct, np.bincount(codes, minlength=len(distinct)).tolist()):
                held[word] = held.get(word, 0) + n
            held[_END] = held.get(_END, 0) + batch.num_rows
            if len(held) > 500_000:
                yield from flush()
        if held:
            yield from flush()

    return texts.mapInArrow(trimmed(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def own_words(counts: DataFrame) -> DataFrame:
    """(word, n, sym) of the words with a symbol of their own, stored; symbols follow the order of frequency, then the word's."""
    ranked = stored(counts.where(F.col("n") >= OWN_LEAST).orderBy(F.desc("n"), "word").withColumn("place", F.monotonically_increasing_id()))
    # monotonically_increasing_id is a partition's number before 33 bits of a row's: partitions' sizes make it dense
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = counts.sparkSession.createDataFrame([(p, _CLASSES + b) for (p, _), b in zip(sizes, before)], "part long, start long")
    placed = ranked.withColumn("part", part).join(F.broadcast(starts), "part")
    out = stored(placed.select("word", "n", (F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("sym")))
    drop_stored(ranked)
    return out


class Vocabulary:
    """What there is to know of the training tokens but the words themselves; small whatever the corpus."""

    def __init__(self, total: int, distinct: int, own: int, classes: dict[int, tuple[int, int]], twice: int):
        """classes: for each order of frequency of the rare words, their number and their occurrences."""
        self.total, self.distinct, self.own = total, distinct, own
        self.size = _CLASSES + own
        self.whole = max(total + ADDED * (distinct + 1), 1e-9)
        self.unit = np.log10(self.whole) if total else 0.0
        #: base probabilities of the classes, and log10 of what a class has in all, so that a word's share is its base probability over it
        self.rare, self.mass = np.zeros(_CLASSES), np.zeros(_CLASSES)
        for c in range(_RARE):
            n, occurrences = classes.get(c, (0, 0))
            self.rare[c] = (occurrences + ADDED * n) / self.whole
            self.mass[c] = np.log10(occurrences + ADDED * n) if n else 0.0
        self.rare[_UNKNOWN] = ADDED / self.whole
        self.once, self.twice = classes.get(0, (0, 0))[0], twice

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADDED) / self.whole

    def rare_symbols(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts == 0, _UNKNOWN, np.log2(np.maximum(counts, 1)).astype(np.int64))

    def shares(self, counts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """log10 of the words' shares of their symbols."""
        rare = symbols < _RARE
        return np.where(rare, np.log10(counts + ADDED) - self.mass[np.where(rare, symbols, 0)], 0.0)


class Known:
    """Counts and symbols of words by their hash."""

    def __init__(self, vocabulary: Vocabulary, rare: np.ndarray, own: np.ndarray, own_counts: np.ndarray, own_symbols: np.ndarray):
        """rare: hashes whose last bits are the count instead, sorted; own: hashes, sorted, and their words' counts and symbols."""
        self.vocabulary, self.rare, self.own, self.own_counts, self.own_symbols = vocabulary, rare, own, own_counts, own_symbols

    @staticmethod
    def packed(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (hashes & ~np.uint64(OWN_LEAST - 1)) | counts.astype(np.uint64)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, low = np.zeros(len(hashes), np.int64), np.uint64(OWN_LEAST - 1)
        if len(self.rare):
            found = self.rare[np.minimum(np.searchsorted(self.rare, hashes & ~low), len(self.rare) - 1)]
            counts = np.where((found ^ hashes) <= low, found & low, 0).astype(np.int64)
        symbols = self.vocabulary.rare_symbols(counts)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            hit = np.flatnonzero(self.own[at] == hashes)
            counts[hit], symbols[hit] = self.own_counts[at[hit]], self.own_symbols[at[hit]]
        return counts, symbols


def _encode(vocabulary: Vocabulary, text: pa.Array, look_up):
    """Columns syms (uint32, end included), n_tokens, n_known, base and share (log10 sums) of texts."""
    words, ends = split_words(text, LOWER)
    codes, distinct = coded(words)
    counts, symbols = look_up([*distinct, _END])
    share = vocabulary.shares(counts, symbols)
    base = np.log10(counts + ADDED) - vocabulary.unit
    n = len(ends) - 1
    k = np.diff(ends)
    whole = np.full(len(codes) + n, len(distinct), np.int64)  # the end's code
    inside = np.ones(len(whole), bool)
    stops = ends[1:] + np.arange(n)
    inside[stops] = False
    whole[inside] = codes
    starts = stops - k
    add = lambda x: np.add.reduceat(x[whole], starts) if n else np.empty(0)
    flat = symbols[whole].astype(np.uint32)
    syms = [flat[a : b + 1].tobytes() for a, b in zip(starts.tolist(), stops.tolist())]
    return [pa.array(syms, pa.binary()), pa.array(k + 1), pa.array(add((counts > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(share))]


_ENCODED = "id {0}, held boolean, block long, syms binary, n_tokens long, n_known long, base double, share double"
_NAMES = ["id", "held", "block", "syms", "n_tokens", "n_known", "base", "share"]


def _hashed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(batch.column(0).to_pylist()).view(np.int64)), *batch.columns[1:]], names=["h", *batch.schema.names[1:]])


def _encoded(docs: DataFrame, counts: DataFrame, own: DataFrame, vocabulary: Vocabulary, kind: str, most: int) -> DataFrame:
    """docs (id, held, text) as symbols, in blocks of some BLOCK bytes of text, stored."""
    context = docs.sparkSession.sparkContext
    docs = docs.select("id", "held", "text")
    shared = context.broadcast(vocabulary)
    if vocabulary.distinct <= most:

        def rare_of(batches):
            for batch in batches:
                yield pa.record_batch([pa.array(Known.packed(_hashes(batch.column(0).to_pylist()), batch.column(1).to_numpy()).view(np.int64))], names=["h"])

        rare = np.sort(counts.where(F.col("n") < OWN_LEAST).mapInArrow(rare_of, "h long").toArrow().column("h").to_numpy().view(np.uint64))
        mine = own.mapInArrow(_hashed, "h long, n long, sym long").toArrow()
        h = mine.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        table = context.broadcast(Known(vocabulary, rare, h[order], mine.column("n").to_numpy()[order], mine.column("sym").to_numpy()[order].astype(np.uint32)))
        del rare, mine, h, order

        def run(batches):
            for block, batch in numbered(batches, 2, BLOCK):
                numbers = pa.array(np.full(batch.num_rows, block))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], numbers, *_encode(shared.value, batch.column(2), lambda words: table.value(_hashes(words)))], names=_NAMES)

        out = stored(docs.mapInArrow(trimmed(run), _ENCODED.format(kind)))
        table.destroy()
        shared.destroy()
        return out

    def dealt(batches):
        for block, batch in numbered(batches, 2, BLOCK):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, block))], names=["id", "held", "text", "block"])

    def words_of(batches):
        """The distinct words of the texts of a block, some perhaps more than once."""
        for batch in batches:
            numbers = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in zip(cuts, cuts[1:]):
                _, distinct = coded(split_words(batch.column(0).slice(i, j - i), LOWER)[0])
                distinct.append(_END)
                yield pa.record_batch([pa.array(np.full(len(distinct), numbers[i])), pa.array(distinct, pa.binary())], names=["block", "word"])

    blocks = stored(docs.mapInArrow(dealt, f"id {kind}, held boolean, text string, block long"))
    # a word comes once for each block that has it, so no word has more rows than there are blocks
    named = counts.join(own.select("word", "sym"), "word", "left")
    met = blocks.select("text", "block").mapInArrow(words_of, "block long, word binary").distinct().join(named, "word").select("block", "word", "n", "sym")

    def run_joined(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.column("n").to_numpy()
        sym = right.column("sym").to_numpy()
        sym = np.where(np.isnan(sym), shared.value.rare_symbols(n), sym).astype(np.int64)
        known = dict(zip(right.column("word").to_pylist(), zip(n.tolist(), sym.tolist())))

        def look_up(words):
            return tuple(np.array([known.get(w, (0, _UNKNOWN))[k] for w in words], np.int64) for k in (0, 1))

        text = left.column("text").combine_chunks()
        return pa.Table.from_arrays([left.column("id"), left.column("held"), left.column("block"), *_encode(shared.value, text.chunk(0) if isinstance(text, pa.ChunkedArray) else text, look_up)], names=_NAMES)

    out = stored(blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(run_joined, _ENCODED.format(kind)))
    drop_stored(blocks)
    shared.destroy()
    return out


class Lanes:
    """Sequences side by side, the longest first: the symbols at time t are flat[offsets[t] : offsets[t + 1]], those of the sequences that run that long."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        """flat: the sequences' symbols, one after the other; each has one at least."""
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        steps = int(self.lengths[0]) if len(lengths) else 0
        self.running = np.searchsorted(-self.lengths, -np.arange(steps + 1), side="left")
        self.offsets = np.concatenate([[0], np.cumsum(self.running[:steps])])
        lane = np.empty(len(lengths), np.int64)
        lane[self.order] = np.arange(len(lengths))
        time = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.flat = np.empty_like(flat)
        self.flat[self.offsets[time] + np.repeat(lane, lengths)] = flat

    def segments(self) -> list[tuple[int, int]]:
        """Runs of times with about _SEGMENT tokens, one time at least."""
        out, a = [], 0
        while a < len(self.offsets) - 1:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + _SEGMENT, side="right")) - 1)
            out.append((a, b))
            a = b
        return out


class Model:
    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """Start probabilities (K), transitions (K x K) and emissions (symbols x K)."""
        self.first, self.move, self.emit = first, move, emit

    @property
    def _every(self) -> int:
        """Steps after which probabilities are scaled: a step may make them some 1e-9 of what they were."""
        return 2 if self.emit.dtype == np.float32 else 16

    def _forward(self, lanes: Lanes, a: int, b: int, alpha: np.ndarray, logs: np.ndarray | None = None):
        """The states' scaled forward probabilities at the times from a to b, and the symbols' own, which add up to one. alpha: those at time a - 1.

        Adds log10 of all that is divided by to logs, a number for each sequence.
        """
        at = (lanes.offsets[a : b + 1] - lanes.offsets[a]).tolist()
        emitted = self.emit[lanes.flat[lanes.offsets[a] : lanes.offsets[b]]]
        whole = emitted.sum(axis=1)
        emitted /= whole[:, None]
        out, every, move = np.empty_like(emitted), self._every, self.move
        for t in range(a, b):
            i, j = at[t - a], at[t - a + 1]
            row = out[i:j]
            if t:
                np.matmul(alpha[: j - i], move, out=row)
                row *= emitted[i:j]
            else:
                np.multiply(emitted[i:j], self.first, out=row)
            if t % every == 0:
                total = row.sum(axis=1)
                row /= total[:, None]
                if logs is not None:
                    logs[: j - i] += np.log10(total)
            alpha = row
        if logs is not None:
            lane = np.arange(len(whole)) - np.repeat(lanes.offsets[a:b] - lanes.offsets[a], lanes.running[a:b])
            logs += np.bincount(lane, weights=np.log10(whole), minlength=len(logs))
        return out, emitted

    def likelihoods(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each of the sequences in flat."""
        lanes = Lanes(flat, lengths)
        logs, alpha = np.zeros(len(lengths)), np.empty((0, len(self.first)))
        for a, b in lanes.segments():
            states, _ = self._forward(lanes, a, b, alpha, logs)
            # sequences that end here: what is left of their probability
            ends = np.flatnonzero((lanes.lengths > a) & (lanes.lengths <= b))
            logs[ends] += np.log10(states[lanes.offsets[lanes.lengths[ends] - 1] - lanes.offsets[a] + ends].sum(axis=1))
            alpha = states[lanes.offsets[b - 1] - lanes.offsets[a] :].copy()
        out = np.empty(len(lengths))
        out[lanes.order] = logs
        return out

    def expect(self, flat: np.ndarray, lengths: np.ndarray, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Adds the expected counts over the sequences in flat.

        Alpha is kept at the segments' edges and made again within one, beta is
        carried from one to the one before. What a time's symbol and all after
        it bring, times what the states before it predict, is the states'
        probability, but for a factor that they add up to: so only the
        recursions go step by step.
        """
        k, lanes = len(self.first), Lanes(flat, lengths)
        segments, every, back_move = lanes.segments(), self._every, np.ascontiguousarray(self.move.T)
        edges = [np.empty((0, k), self.emit.dtype)]
        for a, b in segments[:-1]:
            edges.append(self._forward(lanes, a, b, edges[-1])[0][lanes.offsets[b - 1] - lanes.offsets[a] :].copy())
        beta, back, onward = np.ones((len(lengths), k), self.emit.dtype), np.zeros((k, k)), None
        for a, b in reversed(segments):
            edge = edges.pop()
            alpha, onwards = self._forward(lanes, a, b, edge)
            at = (lanes.offsets[a : b + 1] - lanes.offsets[a]).tolist()
            for t in range(b - 1, a - 1, -1):
                if onward is not None:  # sequences that go on; for those that end here beta is still one
                    np.matmul(onward, back_move, out=beta[: len(onward)])
                    if t % every == 0:
                        beta[: len(onward)] /= beta[: len(onward)].sum(axis=1)[:, None]
                onward = onwards[at[t - a] : at[t - a + 1]]
                onward *= beta[: len(onward)]
            onward = onward.copy()
            before = np.arange(at[1], at[-1]) - np.repeat(lanes.running[a : b - 1], lanes.running[a + 1 : b])
            for i in range(0, at[-1], _PART):
                j = min(at[-1], i + _PART)
                x = onwards[i:j]
                opening = np.broadcast_to(edge[: at[1]] if a else np.zeros((1, k), x.dtype), (at[1], k))[i:j]
                states = np.concatenate([opening, alpha[before[max(0, i - at[1]) : max(0, j - at[1])]]])
                both = states @ self.move
                if not a:
                    both[: len(opening)] = self.first
                both *= x
                total = both.sum(axis=1)[:, None]
                back += states.T @ (x / total)
                np.divide(both, total, out=x)  # from here on, the states' probabilities
            symbols = lanes.flat[lanes.offsets[a] : lanes.offsets[b]]
            for s in range(k):
                emit[:, s] += np.bincount(symbols, weights=onwards[:, s], minlength=len(emit))
            if not a:
                first += onwards[: at[1]].sum(axis=0)
        move += back * self.move


class Whole:
    """A model of all symbols, held as expected counts of own words, four bytes each: emissions are made of them as they are asked for."""

    def __init__(self, first: np.ndarray, move: np.ndarray, rare: np.ndarray, sums: np.ndarray, added: np.ndarray, total: np.ndarray):
        """rare: the classes' emissions. sums: own words' expected counts, to which added (one for each word) comes in all states. total: what the counts are divided by."""
        self.first, self.move, self.rare, self.sums, self.total = first, move, rare, sums, total
        # own words go by frequency, so those with the same stand together
        self.starts = np.flatnonzero(np.diff(added, prepend=np.nan))
        self.added = added[self.starts]

    def of(self, symbols: np.ndarray, kind=np.float64) -> Model:
        """The model of these symbols alone."""
        emit, own = np.empty((len(symbols), len(self.total)), kind), symbols >= _CLASSES
        emit[~own] = self.rare[symbols[~own]]
        places = symbols[own] - _CLASSES
        rows = self.sums[places].astype(np.float64)
        rows += self.added[np.searchsorted(self.starts, places, side="right") - 1][:, None]
        rows /= self.total
        emit[own] = rows
        return Model(self.first.astype(kind), self.move.astype(kind), emit)

    @property
    def emit(self) -> np.ndarray:
        """All emissions."""
        return self.of(np.arange(_CLASSES + len(self.sums))).emit


def classes_of(pairs: np.ndarray, counts: np.ndarray, states: int) -> np.ndarray:
    """A class for each of the most frequent words, from the counts of pairs of neighbours among them: centres far apart, then the nearest mean, in turn."""
    sides = [x / np.maximum(x.sum(axis=1), 1)[:, None] for x in (pairs, pairs.T)]
    x = np.sqrt(np.concatenate(sides, axis=1))
    centres = x[[0]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(states, len(x)):
        centres = np.concatenate([centres, x[[int((far * np.sqrt(counts)).argmax())]]])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    label = np.zeros(len(x), np.int64)
    for _ in range(20):
        label = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        for c in np.unique(label):
            of = label == c
            centres[c] = (x[of] * counts[of, None]).sum(axis=0) / counts[of].sum()
    return label


def neighbours(encoded: DataFrame, words: int) -> np.ndarray:
    """How often each of the `words` most frequent words stands before each: words x words sums, at most, reach the driver."""

    def run(batches):
        total = np.zeros(words * words, np.int64)
        for flat, lengths in _gathered(batches):
            rank = flat.astype(np.int64) - _CLASSES
            good = (rank >= 0) & (rank < words)
            both = good[:-1] & good[1:]
            both[np.cumsum(lengths)[:-1] - 1] = False
            at = np.flatnonzero(both)
            total += np.bincount(rank[at] * words + rank[at + 1], minlength=words * words)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    sums = encoded.select("syms").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(words * words)
    out[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(words, words)


def _gathered(batches, column: int = 0, most: int = _TOKENS):
    """Symbols of rows and their lengths, some _TOKENS of them at a time."""
    held, size = [], 0
    for batch in pieces_of(batches, column, 4 * most):
        for x in batch.column(column).to_pylist():
            if held and size + len(x) > 4 * most:
                yield np.frombuffer(b"".join(held), np.uint32), np.fromiter(map(len, held), np.int64, len(held)) // 4
                held, size = [], 0
            held.append(x)
            size += len(x)
    if held:
        yield np.frombuffer(b"".join(held), np.uint32), np.fromiter(map(len, held), np.int64, len(held)) // 4


def local(flat: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct symbols, and the symbols as places among them."""
    if size > 1 << 24:
        return np.unique(flat, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[flat] = True
    symbols = np.flatnonzero(seen)
    place = np.empty(size, np.int32)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[flat]


#: Words of a bucket of sums: every so manieth of them, so that frequent and rare ones are in all.
_BUCKET = 1 << 12
_SUMS = "bucket long, sums binary"


def _packed(first: np.ndarray, move: np.ndarray, symbols: np.ndarray, emit: np.ndarray, buckets: int):
    """Sums of a task by bucket of words. Bucket -1 has the starts, moves and classes as they are.

    Another has, for each word, its place, its sum over the states, and the
    states' shares of that in steps of 1 / 65,535, their high bytes first.
    """
    states, rare = len(first), np.zeros((_CLASSES, len(first)))
    few = symbols < _CLASSES
    rare[symbols[few]] = emit[few]
    yield -1, np.concatenate([first[None], move, rare]).tobytes()
    total = emit.sum(axis=1)
    at = np.flatnonzero(~few & (total > 0))
    word = symbols[at].astype(np.int64) - _CLASSES
    bucket = word % buckets
    order = np.argsort(bucket, kind="stable")
    at, place, bucket = at[order], (word // buckets)[order].astype("<u2"), bucket[order]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(at)]
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            here = at[i:j]
            shares = np.rint(emit[here] * (65_535 / total[here])[:, None]).astype(">u2")
            yield int(bucket[i]), place[i:j].tobytes() + total[here].astype("<f4").tobytes() + shares.view(np.uint8).reshape(-1, states, 2).transpose(2, 0, 1).tobytes()


def _unpacked(sums: bytes, states: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the bucket, and sums by state."""
    n = len(sums) // (6 + 2 * states)
    planes = np.frombuffer(sums, np.uint8, offset=6 * n).reshape(2, n, states)
    shares = planes[0] * 256.0 + planes[1]
    total = np.frombuffer(sums, "<f4", n, 2 * n)
    return np.frombuffer(sums, "<u2", n), shares * (total / shares.sum(axis=1))[:, None]


def _batches(packed):
    for bucket, sums in packed:
        yield pa.record_batch([pa.array([bucket], pa.int64()), pa.array([sums], pa.binary())], names=["bucket", "sums"])


def _added(states: int, names: list[str], buckets: int):
    """Adds up the sums of a partition's buckets: (key, s0..), a key being a symbol, -1 for the starts, and from -2 down for the moves."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket < 0:
                    held[bucket] = held.get(bucket, 0) + np.frombuffer(sums).reshape(-1, states)
                    continue
                places, values = _unpacked(sums, states)
                if bucket not in held:
                    held[bucket] = np.zeros((_BUCKET + 1, states))
                held[bucket][places] += values
        for bucket, values in held.items():
            keys = _CLASSES + bucket + buckets * np.arange(len(values)) if bucket >= 0 else np.concatenate([-1 - np.arange(states + 1), np.arange(_CLASSES)])
            some = np.flatnonzero(values.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), *[pa.array(values[some, s].astype(np.float32)) for s in range(states)]], names=["key", *names])

    return run


class Trainer:
    """Passes of Baum-Welch over learnt (encoded rows); the model has the classes' emissions, and own words' are broadcast or a stored table.

    The driver holds the broadcast own words' sums once, four bytes a state, and
    Arrow's rows of them while they arrive.
    """

    def __init__(self, encoded: DataFrame, own: DataFrame, vocabulary: Vocabulary, states: int, most: int):
        self.encoded, self.learnt, self.own, self.vocabulary, self.states = encoded, encoded.where("not held"), own, vocabulary, states
        self.joined = vocabulary.own > most
        self.context = encoded.sparkSession.sparkContext
        self.names = [f"s{i}" for i in range(states)]
        self.summed = "key long, " + ", ".join(f"{n} float" for n in self.names)
        if self.joined:
            self.pairs = stored(encoded.select("block", "syms").mapInArrow(self._own_of, "block long, sym long").distinct())
        else:
            self.counts = np.zeros(vocabulary.own)
            found = own.select("sym", "n").toArrow()
            self.counts[found.column("sym").to_numpy() - _CLASSES] = found.column("n").to_numpy()

    @staticmethod
    def _own_of(batches):
        for batch in pieces_of(batches, 1):
            numbers = batch.column(0).to_numpy()
            for block in np.unique(numbers):
                of = batch.column(1).filter(pa.array(numbers == block)).to_pylist()
                syms = np.unique(np.frombuffer(b"".join(of), np.uint32))
                syms = syms[syms >= _CLASSES].astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(syms), block)), pa.array(syms)], names=["block", "sym"])

    def start(self) -> Model | Whole:
        """Words of a class lean to its state; all other symbols are in all states alike."""
        v, k = self.vocabulary, self.states
        head = self.own.where(F.col("sym") < _CLASSES + HEAD).orderBy("sym").select("n").toArrow().column("n").to_numpy().astype(float)
        emit = np.ones((_CLASSES + len(head), k)) / k
        move = np.ones((k, k))
        if len(head):
            pairs = neighbours(self.learnt, len(head))
            label = classes_of(pairs, head, k)
            lean = np.eye(k)[label]
            mass = np.maximum(head @ lean, 1e-3 * head.sum())
            emit[:] = mass / mass.sum()
            emit[_CLASSES:] = 0.9 * lean + 0.1 * emit[_CLASSES:]
            move += lean.T @ pairs @ lean
        emit *= np.random.default_rng(7).uniform(0.9, 1.1, emit.shape)
        other = emit[:_CLASSES].mean(axis=0)
        sums = emit * (np.concatenate([v.rare, v.unigram(head)]) * v.whole)[:, None]
        if not self.joined:
            own = np.empty((v.own, k), np.float32)
            own[: len(head)] = sums[_CLASSES:]
            np.multiply((v.unigram(self.counts[len(head) :]) * v.whole)[:, None], other, out=own[len(head) :], casting="same_kind")
            return self._made(np.ones(k), move, sums[:_CLASSES], own)
        spark = self.own.sparkSession
        leans = F.broadcast(spark.createDataFrame([(_CLASSES + i, *map(float, row)) for i, row in enumerate(emit[_CLASSES:])], "sym long, " + ", ".join(f"{n} double" for n in self.names)))
        base = F.col("n") + ADDED
        own = self.own.join(leans, "sym", "left").select("sym", "n", *[(base * F.coalesce(n, F.lit(float(other[i])))).alias(n) for i, n in enumerate(self.names)])
        return self._made(np.ones(k), move, sums[:_CLASSES], own)

    def _made(self, first: np.ndarray, move: np.ndarray, rare: np.ndarray, own) -> Model | Whole:
        """The model of expected counts. Unknown words get what words seen once had, and these what words seen twice suggest."""
        v = self.vocabulary
        rare = rare.copy()
        if v.once:
            rare[_UNKNOWN] = rare[0]
            rare[0] = rare[0] * min(1.0, 2 * v.twice / v.once)
        rare += 2.0 * v.rare[:, None] + 1e-12 * (v.rare[:, None] > 0)
        move, first = move + 0.1, first + 0.1
        first, move = first / first.sum(), move / move.sum(axis=1)[:, None]
        if not self.joined:
            plus = 2.0 * v.unigram(self.counts)
            total = rare.sum(axis=0) + own.sum(axis=0, dtype=np.float64) + plus.sum()
            return Whole(first, move, rare / total, own, plus, total)
        added = stored(own.select("sym", *[(F.col(n) + 2.0 * (F.col("n") + ADDED) / v.whole).alias(n) for n in self.names]))
        total = rare.sum(axis=0) + np.array(added.agg(*[F.coalesce(F.sum(n), F.lit(0.0)) for n in self.names]).first())
        emit = stored(added.select("sym", *[(F.col(n) / float(total[i])).alias(n) for i, n in enumerate(self.names)]))
        drop_stored(added)
        model = Model(first, move, rare / total)
        model.own = emit
        return model

    def _tables(self, model: Model, encoded: DataFrame):
        """Blocks of encoded with their symbols' emissions."""
        rows = self.pairs.join(model.own, "sym").select("block", "sym", *self.names)
        return encoded.groupBy("block").cogroup(rows.groupBy("block"))

    @staticmethod
    def _met(model: Model, flat: np.ndarray, right: pa.Table, names) -> tuple[Model, np.ndarray, np.ndarray]:
        """The model of a block's symbols alone, these symbols, and the symbols as places among them."""
        symbols, places = np.unique(flat, return_inverse=True)
        theirs = right.column("sym").to_numpy()
        emit = np.concatenate([model.emit, np.stack([right.column(n).to_numpy() for n in names], axis=1)])
        keys = np.concatenate([np.arange(_CLASSES), theirs])
        order = np.argsort(keys)
        at = order[np.searchsorted(keys[order], symbols)]
        return Model(model.first, model.move, emit[at]), symbols, places

    def _shared(self, model: Model | Whole, kind=np.float64):
        return self.context.broadcast(Model(model.first.astype(kind), model.move.astype(kind), model.emit.astype(kind)) if self.joined else model)

    def improved(self, model: Model | Whole) -> Model | Whole:
        """One pass over all training texts; model is used up."""
        k, size, names = self.states, self.vocabulary.size, self.names
        buckets = max(1, -(-self.vocabulary.own // _BUCKET))
        shared = self._shared(model, np.float32)
        if not self.joined:

            def run(batches):
                first, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
                for flat, lengths in _gathered(batches):
                    whole = shared.value
                    symbols, places = local(flat, size)
                    mine = np.zeros((len(symbols), k))
                    whole.of(symbols, np.float32).expect(places, lengths, first, move, mine)
                    emit[symbols] += mine
                at = np.flatnonzero(emit.any(axis=1))
                yield from _batches(_packed(first, move, at, emit[at], buckets))

            parts = self.learnt.select("syms").mapInArrow(trimmed(run), _SUMS)
        else:
            met = self._met

            def run_joined(left: pa.Table, right: pa.Table) -> pa.Table:
                first, move, every = np.zeros(k), np.zeros((k, k)), []
                for flat, lengths in _gathered(left.select(["syms"]).to_batches()):
                    mine, symbols, places = met(shared.value, flat, right, names)
                    emit = np.zeros((len(symbols), k))
                    mine.emit = mine.emit.astype(np.float32)
                    mine.expect(places, lengths, first, move, emit)
                    every += _batches(_packed(np.zeros(k), np.zeros((k, k)), symbols, emit, buckets))
                every += _batches(_packed(first, move, np.empty(0, np.int64), np.empty((0, k)), buckets))
                return pa.Table.from_batches(every)

            parts = self._tables(model, self.learnt.select("block", "syms")).applyInArrow(run_joined, _SUMS)
        summed = stored(parts.repartition("bucket").mapInArrow(_added(k, names, buckets), self.summed))
        shared.destroy()
        first, move, rare = self._collected(summed, model)
        free_memory()
        if not self.joined:
            drop_stored(summed)
            return self._made(first, move, rare, model.sums)
        own = self.own.join(summed.withColumnRenamed("key", "sym"), "sym", "left").select("sym", "n", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
        out = self._made(first, move, rare, own)
        drop_stored(summed, model.own)
        return out

    def _collected(self, summed: DataFrame, model: Model | Whole) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sums of starts, moves and classes; those of broadcast own words take the place of the model's."""
        k = self.states
        first, move, rare = np.zeros(k), np.zeros((k, k)), np.zeros((_CLASSES, k))
        if self.joined:
            summed = summed.where(F.col("key") < _CLASSES)
        else:
            model.sums[:] = 0
        for batch in summed.select("key", *self.names).toArrow().to_batches():
            keys, values = batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            moves, classes, words = keys < -1, (keys >= 0) & (keys < _CLASSES), keys >= _CLASSES
            first += values[keys == -1].sum(axis=0)
            move[-2 - keys[moves]] = values[moves]
            rare[keys[classes]] = values[classes]
            if not self.joined:
                model.sums[keys[words] - _CLASSES] = values[words]
        return first, move, rare

    def scored(self, model: Model | Whole, kind: str) -> DataFrame:
        """(id, held, n_tokens, n_known, base, score) of all encoded rows."""
        shared, schema = self._shared(model), f"id {kind}, held boolean, n_tokens long, n_known long, base double, score double"
        out = ["id", "held", "n_tokens", "n_known", "base", "score"]
        rows = self.encoded.select("id", "held", "n_tokens", "n_known", "base", "share", "syms", "block")
        size = self.vocabulary.size

        def run(batches):
            for batch in pieces_of(batches, 6, 4 * _TOKENS):
                whole = shared.value
                flat = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint32)
                symbols, places = local(flat, size)
                logs = whole.of(symbols).likelihoods(places, batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(logs + batch.column(5).to_numpy())], names=out)

        if not self.joined:
            return rows.mapInArrow(trimmed(run), schema)
        met, names = self._met, self.names

        def run_joined(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return left.select(range(5)).append_column("score", pa.array([], pa.float64()))
            mine, _, places = met(shared.value, np.frombuffer(b"".join(left.column("syms").to_pylist()), np.uint32), right, names)
            logs = mine.likelihoods(places, left.column("n_tokens").to_numpy())
            return pa.Table.from_arrays([*left.columns[:5], pa.array(logs + left.column("share").to_numpy())], names=out)

        return self._tables(model, rows).applyInArrow(run_joined, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", states: int = STATES, passes: int = PASSES, broadcast_words: int = BROADCAST_WORDS, broadcast_own: int = BROADCAST_OWN) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Learns from the rows whose crc32 of the id, as text, modulo 10 isn't 0
    (null ids are among them). Tokens are the words between ASCII white space,
    A-Z in lower case, and one end; null and empty texts have the end alone.
    base_score is the log10 probability under the smoothed unigrams, score that
    under the hidden Markov model, both over the same outcomes: the distinct
    training tokens and one unknown. Repeated rows count and are scored each.
    Without training rows every token is unknown and both scores are 0. Other
    columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]
    counts = stored(word_counts(rows.where("not held").select("text")))
    own = own_words(counts)
    order = F.when(F.col("n") < OWN_LEAST, F.floor(F.log2("n")).cast("int")).otherwise(_RARE)
    kinds = {r["c"]: r for r in counts.groupBy(order.alias("c")).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.sum((F.col("n") == 2).cast("long")).alias("twice")).collect()}
    total, distinct = (sum(r[x] for r in kinds.values()) for x in ("n", "v"))
    vocabulary = Vocabulary(total, distinct, kinds[_RARE]["v"] if _RARE in kinds else 0, {c: (r["v"], r["n"]) for c, r in kinds.items() if c < _RARE}, sum(r["twice"] for r in kinds.values()))
    encoded = _encoded(rows, counts, own, vocabulary, kind, broadcast_words)
    trainer = Trainer(encoded, own, vocabulary, states, broadcast_own)
    model = trainer.start()
    for _ in range(passes):
        model = trainer.improved(model)
    drop_stored(counts, own)
    out = trainer.scored(model, kind)
    scores = ["base", "score"] if total else [F.lit(0.0)] * 2
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), *[F.col(c).alias(n) if total else c.alias(n) for c, n in zip(scores, ("base_score", "score"))])
