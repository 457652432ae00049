"""Language identification by unigrams of pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum, over all ways to cut it into pieces, of the
product of their probabilities, which a forward recursion gives; a text's is the
product over its words. The pieces' probabilities come from one pass of
expected counts (forward and backward) over all training texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.llm._spark import bounded_batches, by_place
from lexiweave.llm._text import LOWER, coded, pieces_of, split_words, trimmed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Ends of pieces that are looked up together; no piece is longer.
_STEPS = 64
#: Bytes of distinct words that a task keeps.
_KEPT = 32 << 20
_BITS = 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Probabilities are held times this to the power of the bytes, so that long words don't underflow.
_LIFT = 8.0
_OPEN = "▁".encode()
#: Bytes of text that a task cuts up at a time.
_SLICE = 2 << 20
_CACHE: dict = {}


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


class Pieces:
    """The vocabulary as byte strings in lower case, the 256 single bytes first, with a hash table over them."""

    def __init__(self, model: str):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=model)
        found: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.rank = [40_000.0] * 256
        for i in range(source.get_piece_size()):
            if source.is_control(i) or source.is_unknown(i) or source.is_byte(i):
                continue
            piece = source.id_to_piece(i).encode().translate(LOWER)
            if piece not in found:
                found[piece] = len(found)
                self.rank.append(float(i))
        self.pieces = list(found)
        self.lengths = np.array([len(p) for p in self.pieces])
        self.longest = int(self.lengths.max())
        keys = np.array([self._hash(p) for p in self.pieces], np.uint64)
        assert len(np.unique(keys)) == len(keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        # where a key of so many leading bits would start among the sorted keys
        self.starts = np.searchsorted(self.keys >> np.uint64(64 - _BITS), np.arange((1 << _BITS) + 1, dtype=np.uint64))
        self.used = np.unique(self.lengths)
        assert self.longest <= _STEPS

    @staticmethod
    def _hash(piece: bytes) -> int:
        h, power = 0, 1
        for b in piece:
            h = (h + (b + 1) * power) % (1 << 64)
            power = power * int(_BASE) % (1 << 64)
        return (h * int(_MIX) ^ (h >> 32)) % (1 << 64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed substrings, -1 for none."""
        h = h * _MIX ^ (h >> np.uint64(32))
        bucket = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            i = at[live]
            same = self.keys[i] == h[live]
            out[live[same]] = self.ids[i[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


def pieces(model: str) -> Pieces:
    """The vocabulary, kept in this process."""
    if model not in _CACHE:
        _CACHE[model] = Pieces(model)
    return _CACHE[model]


class Lattice:
    """All occurrences of pieces in some words, each with its opening mark, whatever its length.

    Words go longest first, so that those of t bytes or more are a prefix. The
    ends of _STEPS bytes are looked up together; after that many, what the
    recursions still need is scaled anew, by powers of two for each word.
    """

    def __init__(self, words: list[bytes], vocabulary: Pieces):
        flat = [_OPEN + w for w in words]
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        self.n, self.vocabulary = len(flat), vocabulary
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.steps = int(self.size[0]) if self.n else 0
        #: words of t bytes or more, for t from 0 to one more than the longest has
        self.running = np.searchsorted(-self.size, -np.arange(self.steps + 2), side="right")
        self.start = np.cumsum(self.size) - self.size
        data = np.frombuffer(b"".join(flat[i] for i in self.order), np.uint8)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(data), inverse)]))
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _BASE)]))[:-1]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])

    def edges(self, lo: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end from lo + 1 on, _STEPS at most, the pieces that end there: (length, words, ids)."""
        hi = min(lo + _STEPS, self.steps)
        live = self.running[lo + 1 : hi + 1]
        t = np.repeat(np.arange(lo + 1, hi + 1), live)
        word = np.arange(len(t)) - np.repeat(np.cumsum(live) - live, live)
        end = self.start[word] + t
        out: list[list] = [[] for _ in range(hi - lo)]
        for length in self.vocabulary.used[self.vocabulary.used <= hi].tolist():
            first = int(np.searchsorted(t, length))
            a = end[first:] - length
            ids = self.vocabulary.find((self.sums[a + length] - self.sums[a]) * self.back[a])
            at = np.flatnonzero(ids >= 0)
            found, ids = word[first + at], ids[at]
            cuts = np.searchsorted(t[first + at], np.arange(lo + 1, hi + 2)).tolist()
            for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j:
                    out[k].append((length, found[i:j], ids[i:j]))
        return out

    def _forward(self, p: np.ndarray, keep: bool):
        """Probabilities of whole words and their powers of two, in the words' order here; with keep, also all rows, the powers of each block of steps, and the blocks' edges."""
        shape = (self.n, p.shape[1])
        whole, power = np.zeros(shape), np.zeros(shape, np.int64)
        rows, kept, powers, edges = [np.ones(shape)], [np.ones(shape)], [], []
        for lo in range(0, self.steps, _STEPS):
            if lo:
                live = int(self.running[lo + 1])
                rows = [r[:live] for r in rows[-self.vocabulary.longest :]]
                scale = np.frexp(np.maximum.reduce(rows))[1]
                rows = [np.ldexp(r, -scale) for r in rows]
                power[:live] += scale
            here = self.edges(lo)
            if keep:
                powers.append(power.copy())
                edges.append(here)
            for t, found in enumerate(here, lo + 1):
                row = np.zeros((int(self.running[t]), shape[1]))
                for length, at, ids in found:
                    row[at] += rows[-length][at] * p[ids]
                rows.append(row)
                if keep:
                    kept.append(row)
                last = int(self.running[t + 1])
                whole[last : len(row)] = row[last:]
        return whole, power, kept, powers, edges

    def logs(self, p: np.ndarray) -> np.ndarray:
        """[word, language]: natural log of the probability, lift taken out. p: [piece, language], lifted."""
        whole, power, *_ = self._forward(p, False)
        out = np.zeros((self.n, p.shape[1]))
        out[self.order] = np.log(whole) + power * np.log(2) - (self.size * np.log(_LIFT))[:, None]
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """[piece, language]: expected occurrences under the one distribution p, each word counted weight[word, language] times."""
        out = np.zeros((len(p), weight.shape[1]))
        if not self.n:
            return out
        whole, power, alpha, powers, edges = self._forward(p[:, None], True)
        alpha, whole, power = [r[:, 0] for r in alpha], whole[:, 0], power[:, 0]
        weight, later = weight[self.order], np.zeros(self.n, np.int64)
        beta: dict[int, np.ndarray] = {}

        def row(t: int) -> np.ndarray:
            if t not in beta:
                beta[t] = np.zeros(int(self.running[t]))
                beta[t][int(self.running[t + 1]) :] = 1
            return beta[t]

        for block in range(len(edges) - 1, -1, -1):
            lo = block * _STEPS
            live = int(self.running[lo + 1])
            # what makes a share of the product of a row of this block, or of the one before, with one of beta
            share = [np.ldexp(1 / whole[:live], powers[b][:live, 0] + later[:live] - power[:live]) for b in (max(0, block - 1), block)]
            for t in range(lo + len(edges[block]), lo, -1):
                b = row(t)
                for length, at, ids in edges[block][t - 1 - lo]:
                    onward = p[ids] * b[at]
                    part = alpha[t - length][at] * onward * share[t - length > lo][at]
                    for k in range(weight.shape[1]):
                        out[:, k] += np.bincount(ids, weights=part * weight[at, k], minlength=len(p))
                    row(t - length)[at] += onward
                del beta[t]
            edges.pop()
            if block:
                some = [row(t) for t in range(max(0, lo - self.vocabulary.longest + 1), lo + 1)]
                scale = np.frexp(np.maximum.reduce([r[:live] for r in some]))[1]
                later[:live] += scale
                for r in some:
                    r[:live] = np.ldexp(r[:live], -scale)
        return out


def dealt(words: list[bytes]):
    """Cuts words into runs for one lattice each: of so many words, and so many bytes unless one word has more."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    at = 0
    while at < len(words):
        to = min(at + 20_000, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right"))))
        yield at, to
        at = to


def prior(vocabulary: Pieces) -> np.ndarray:
    """Probabilities of the pieces before any text is seen: falling with their place in the vocabulary."""
    p = 1 / (np.array(vocabulary.rank) + 100)
    return p / p.sum()


def _lifted(p: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    scale = _LIFT ** vocabulary.lengths
    return p * (scale[:, None] if p.ndim == 2 else scale)


def train(rows: DataFrame, languages: list[str], model: str) -> np.ndarray:
    """[piece, language] probabilities from rows (text, lang). As many sums as pieces times languages reach the driver, at most."""
    n = len(languages)
    size = len(pieces(model).pieces)
    names = [f"l{i}" for i in range(n)]

    def count(batches):
        vocabulary = pieces(model)
        total, first = np.zeros((size, n)), _lifted(prior(vocabulary), vocabulary)
        place = {name: i for i, name in enumerate(languages)}
        held: dict[bytes, np.ndarray] = {}
        room = 0

        def flush():
            nonlocal room
            words = list(held)
            for i, j in dealt(words):
                total[:] += Lattice(words[i:j], vocabulary).expected(first, np.stack([held[w] for w in words[i:j]]))
            held.clear()
            room = 0

        for batch in pieces_of(batches, 0, _SLICE):
            flat, ends = split_words(batch.column(0), LOWER)
            codes, distinct = coded(flat)
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            table = np.bincount(codes * n + np.repeat(lang, np.diff(ends)), minlength=len(distinct) * n).reshape(-1, n)
            for w, row in zip(distinct, table):
                if w in held:
                    held[w] = held[w] + row
                else:
                    held[w] = row
                    room += len(w)
            if len(held) > 100_000 or room > _KEPT:
                flush()
        flush()
        at = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(at), 1 << 14):
            some = at[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, k].copy()) for k in range(n)]], names=["piece", *names])

    sums = rows.select("text", "lang").mapInArrow(trimmed(count), "piece long, " + ", ".join(f"{x} double" for x in names)).groupBy("piece").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
    p = np.zeros((size, n))
    p[sums["piece"].to_numpy()] = sums[names].to_numpy()
    # what a language has not shown falls back on all languages together, and that on the vocabulary's order
    every = p.sum(axis=1) + 200 * prior(pieces(model))
    p = p + 200 * (every / every.sum())[:, None]
    return p / p.sum(axis=0)


_LETTER = r"\p{L}"


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", model: str = VOCABULARY) -> DataFrame:
    """docs with columns held_out, lang_pred and score added (or replaced, if docs has such columns).

    Learns from the rows with a text and a language whose crc32 of the id, as
    text, modulo 4 isn't 2; only the text is an input. lang_pred is the most
    probable language (the first by name among equals), score its share of the
    probability given the text, languages being equally likely beforehand. A
    text that is null or has no letter gets `und` and score 0, and so does every
    text if no row can be learned from. Repeated rows count and are judged each;
    other columns stay; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    learnt = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(id_col))).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    languages = sorted(r[0] for r in learnt.groupBy("lang").count().select("lang").collect())
    own = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    held = F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out")
    kept = [F.col(f"`{c}`") for c in own]
    if not languages:
        return docs.select(*kept, held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(train(learnt, languages, model))
    at = own.index(text)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(batches):
        vocabulary = pieces(model)
        p = _lifted(shared.value, vocabulary)
        known: dict[bytes, int] = {}  # words seen in this task, and their logs
        size = 0
        store = np.zeros((1 << 12, len(languages)))
        for batch in pieces_of(batches, at, _SLICE):
            flat, ends = split_words(batch.column(at), LOWER)
            codes, distinct = coded(flat)
            if len(known) > 150_000 or size > _KEPT:
                known.clear()
                size = 0
            new = [w for w in distinct if w not in known]
            base = len(known)
            if base + len(new) > len(store):
                store = np.concatenate([store[:base], np.zeros((base + 2 * len(new), len(languages)))])
            for i, j in dealt(new):
                store[base + i : base + j] = Lattice(new[i:j], vocabulary).logs(p)
            size += sum(map(len, new))
            known.update(zip(new, range(base, base + len(new))))
            logs = store[np.array([known[w] for w in distinct], np.int64)][codes] if distinct else np.zeros((0, len(languages)))
            sums = np.concatenate([np.zeros((1, len(languages))), np.cumsum(logs, axis=0)])
            total = sums[ends[1:]] - sums[ends[:-1]]
            total -= total.max(axis=1, keepdims=True)
            share = np.exp(total)
            best = share.argmax(axis=1)
            score = share[np.arange(len(best)), best] / share.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([languages[i] for i in best], pa.string()), pa.array(score)], names=[*own, "lang_pred", "score"])

    out = docs.select(*kept).mapInArrow(trimmed(run), T.StructType([*[docs.schema[c] for c in own], *added]))
    letters = F.coalesce(F.col(f"`{text}`").rlike(_LETTER), F.lit(False))
    return out.select(*kept, held, F.when(letters, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(letters, F.col("score")).otherwise(0.0).alias("score"))


def with_language(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", model: str = VOCABULARY) -> DataFrame:
    """The rows of docs whose text has a language: not those that are null or without a letter. All columns stay."""
    placed, of = by_place(docs)
    return identify(placed, of[id_col], of[text], of[lang], model).where("lang_pred <> 'und'").select(*of.values()).toDF(*docs.columns)
