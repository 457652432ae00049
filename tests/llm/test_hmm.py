import itertools
import math
import os
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from lexiweave.llm import hmm
from pyspark.sql import functions as F

from .conftest import ODD, words_of

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def base(rows):
    token = lambda t: [w for w in (t or "").encode().translate(hmm.LOWER).split()] + [b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(token(t)), sum(c[w] > 0 for w in token(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token(t))) for i, t in rows]


def made():
    texts = [" ".join(words_of(s % 2, 60 + s, 30 + 5000 * (s % 2))) for s in range(60)] + ODD
    return [*enumerate(texts), (None, "w1 w2"), (7, "w1"), (7, "w1")]


@pytest.mark.parametrize("limit", [10**9, -1], ids=["broadcast", "join"])
def test_base_scores(docs, limit):
    rows = made()
    df = docs(rows).withColumn("id", F.lit(1)).withColumn("word", F.lit("x")).withColumn("score", F.lit("own")).withColumn("block", F.lit(2))
    out = hmm.score(df, states=3, passes=1, broadcast_words=limit, broadcast_own=limit)
    assert out.columns == COLUMNS
    got = sorted((tuple(r)[:5] + (round(r["base_score"], 6),) for r in out.collect()), key=repr)
    assert got == sorted((x[:5] + (round(x[5], 6),) for x in base(rows)), key=repr)


def test_joined_tables_give_the_same_scores(docs):
    """Counts and emissions that are joined instead of broadcast change nothing."""
    df = docs(made()).repartition(5)
    want = {(r["doc_id"], r["n_tokens"]): r["score"] for r in hmm.score(df, states=4, passes=2).collect()}
    for words, own in ((-1, 10**9), (10**9, -1), (-1, -1)):
        for r in hmm.score(df, states=4, passes=2, broadcast_words=words, broadcast_own=own).collect():
            assert r["score"] == pytest.approx(want[r["doc_id"], r["n_tokens"]], rel=1e-5)


def test_counts_beyond_32_bits():
    """A word of more than 4.29 billion occurrences keeps its count."""
    v = hmm.Vocabulary(9 * 10**9, 2, 1, {0: (1, 1)}, 0)
    h = hmm._hashes([b"the", b"rare", b"new"])
    known = hmm.Known(v, hmm.Known.packed(h[1:2], np.array([1])), h[:1], np.array([8 * 10**9]), np.array([hmm._CLASSES], np.uint32))
    counts, symbols = known(h)
    assert counts.tolist() == [8 * 10**9, 1, 0]
    assert symbols.tolist() == [hmm._CLASSES, 0, hmm._UNKNOWN]


def test_every_frequent_word_has_its_own_symbol(spark):
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), i % 20 + 1) for i in range(3000)], "word binary, n long").repartition(7)
    got = hmm.own_words(counts).orderBy("sym").collect()
    want = sorted(((i % 20 + 1, f"w{i}".encode()) for i in range(3000) if i % 20 + 1 >= 8), key=lambda x: (-x[0], x[1]))
    assert [(r["n"], bytes(r["word"])) for r in got] == want
    assert [r["sym"] for r in got] == list(range(hmm._CLASSES, hmm._CLASSES + len(want)))


def test_scores_are_probabilities_and_beat_the_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = hmm.score(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["score"] < 0 for r in rows)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def random_model(k, n, seed=0):
    g = np.random.default_rng(seed)
    part = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(g.random(s))
    return hmm.Model(part(k), part(k, k), part(k, n).T.copy())


def likelihood(model, seq):
    """By summing over all paths of states."""
    total = 0.0
    for path in itertools.product(range(len(model.first)), repeat=len(seq)):
        p = model.first[path[0]]
        for a, b in zip(path, path[1:]):
            p *= model.move[a, b]
        for s, x in zip(path, seq):
            p *= model.emit[x, s]
        total += p
    return total


def flat(seqs):
    return np.concatenate(seqs).astype(np.int64), np.array([len(s) for s in seqs])


@pytest.fixture(params=[1, 5, 1 << 18], ids=["each time apart", "small segments", "one segment"])
def segment(request, monkeypatch):
    monkeypatch.setattr(hmm, "_SEGMENT", request.param)
    monkeypatch.setattr(hmm, "_PART", min(request.param + 1, 1 << 17))


def test_forward_is_exact(segment):
    model, r = random_model(3, 5), random.Random(1)
    seqs = [np.array([r.randrange(5) for _ in range(n)]) for n in (1, 2, 5, 3, 7, 1)]
    assert np.allclose(model.likelihoods(*flat(seqs)), [math.log10(likelihood(model, s)) for s in seqs])
    whole = sum(10 ** x for x in model.likelihoods(*flat([np.array(s) for s in itertools.product(range(5), repeat=4)])))
    assert abs(whole - 1) < 1e-9


def test_expected_counts_are_those_of_all_paths(segment):
    """Over whole sequences, wherever the segments part them."""
    model, r = random_model(2, 4), random.Random(2)
    seqs = [np.array([r.randrange(4) for _ in range(n)]) for n in (4, 1, 9, 6, 6)]
    first, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    model.expect(*flat(seqs), first, move, emit)
    want_first, want_move, want_emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s in seqs:
        whole = likelihood(model, s)
        for path in itertools.product(range(2), repeat=len(s)):
            p = model.first[path[0]] * np.prod([model.move[a, b] for a, b in zip(path, path[1:])]) * np.prod([model.emit[x, q] for q, x in zip(path, s)]) / whole
            want_first[path[0]] += p
            for a, b in zip(path, path[1:]):
                want_move[a, b] += p
            for q, x in zip(path, s):
                want_emit[x, q] += p
    assert np.allclose(first, want_first) and np.allclose(move, want_move) and np.allclose(emit, want_emit)


def test_one_long_text_takes_memory_in_proportion_to_its_tokens():
    model = random_model(4, 50)
    g = np.random.default_rng(3)
    lengths = np.array([200_000, *[20] * 255])
    symbols = g.integers(0, 50, lengths.sum())
    tracemalloc.start()
    sums = np.zeros(4), np.zeros((4, 4)), np.zeros((50, 4))
    model.expect(symbols, lengths, *sums)
    logs = model.likelihoods(symbols, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * len(symbols)
    assert sums[0].sum() == pytest.approx(256) and sums[2].sum() == pytest.approx(len(symbols)) and sums[1].sum() == pytest.approx(len(symbols) - 256)
    assert logs[1] == pytest.approx(model.likelihoods(symbols[200_000:200_020], np.array([20]))[0])


def test_driver_holds_own_words_once(spark, monkeypatch):
    """No copies of the model while it is made, and of its broadcasts only that of the scores stays."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(send(self, value)) or sent[-1])
    words = F.expr("concat_ws(' ', transform(sequence(1, 20000), x -> concat('w', x + 20000 * (id % 10))))")
    docs = spark.range(150).select(F.col("id").alias("doc_id"), words.alias("text"))
    tracemalloc.start()
    out = hmm.score(docs, passes=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * 200_000
    assert [os.path.exists(x._path) for x in sent] == [False] * (len(sent) - 1) + [True]
    assert out.where("score < 0 and n_known = n_tokens").count() == 150


def test_emissions_are_made_of_sums():
    g, added = np.random.default_rng(5), np.array([9.0, 9.0, 4.0, 4.0, 4.0, 2.0])
    sums, rare = g.random((6, 3)).astype(np.float32), g.random((hmm._CLASSES, 3))
    whole = hmm.Whole(np.ones(3), np.ones((3, 3)), rare, sums, added, np.array([30.0, 40.0, 50.0]))
    want = np.concatenate([rare, (sums + added[:, None]) / [30.0, 40.0, 50.0]])
    at = np.array([hmm._CLASSES + 5, 0, hmm._CLASSES + 1, hmm._CLASSES - 1])
    assert (whole.emit == want).all() and (whole.of(at).emit == want[at]).all()
    assert whole.of(at, np.float32).emit.dtype == np.float32 and hmm.Whole(*[np.ones(3)] * 2, rare, sums[:0], added[:0], np.ones(3)).emit.tolist() == rare.tolist()


def test_one_state_is_a_distribution(docs):
    """The scores of all outcomes of one token sum to one."""
    v = hmm.Vocabulary(42, 7, 2, {0: (3, 3), 2: (2, 9)}, 0)
    trainer = hmm.Trainer.__new__(hmm.Trainer)
    trainer.vocabulary, trainer.joined, trainer.counts = v, False, np.array([20.0, 10.0])
    g = np.random.default_rng(0)
    model = trainer._made(np.ones(2), np.ones((2, 2)), g.random((hmm._CLASSES, 2)) * (v.rare[:, None] > 0), g.random((2, 2)))
    counts = np.array([20, 10, 1, 1, 1, 4, 5, 0])
    symbols = np.array([hmm._CLASSES, hmm._CLASSES + 1, 0, 0, 0, 2, 2, hmm._UNKNOWN])
    share = v.shares(counts, symbols)
    for s in range(2):
        assert abs(sum(model.emit[k, s] * 10**x for k, x in zip(symbols, share)) - 1) < 1e-9


def test_sums_travel_packed():
    g = np.random.default_rng(4)
    symbols = np.unique(np.concatenate([np.arange(3), g.integers(0, 5 * hmm._BUCKET, 3000)]))
    emit = g.random((len(symbols), 3)) ** 4 * 10.0 ** g.integers(-3, 6, (len(symbols), 1))
    first, move = g.random(3), g.random((3, 3))
    names = ["s0", "s1", "s2"]
    sums = [*hmm._batches(hmm._packed(first, move, symbols, emit, 5)), *hmm._batches(hmm._packed(first, move, symbols[5:], emit[5:], 5))]
    rows = [r for b in hmm._added(3, names, 5)(iter(sums)) for r in b.to_pylist()]
    got = {r["key"]: np.array([r[n] for n in names]) for r in rows}
    assert np.allclose(got[-1], 2 * first) and all(np.allclose(got[-2 - i], 2 * move[i]) for i in range(3))
    for i, (symbol, row) in enumerate(zip(symbols, emit)):
        want = row * (1 if i < 5 else 2)
        assert np.abs(got[symbol] - want).max() <= 2e-5 * want.sum() and got[symbol].sum() == pytest.approx(want.sum(), rel=1e-6)


def test_neighbours_count_pairs_within_texts(spark):
    texts = [[4, 5, 4, 0, 4], [5, 5], [4]]
    df = spark.createDataFrame([(bytearray(np.array(t, np.uint32).tobytes()),) for t in texts], "syms binary").repartition(2)
    assert hmm.neighbours(df, 2).tolist() == [[0, 1], [1, 1]]


def test_each_pass_makes_the_training_texts_likelier(docs):
    """Baum-Welch never loses likelihood, but for what the smoothing takes."""
    rows = [(i, " ".join(words_of(i % 3, 200, 25 + 10 * (i % 3)))) for i in range(40)]
    sums = [sum(r["score"] for r in hmm.score(docs(rows), states=3, passes=p).collect() if not r["held_out"]) for p in (0, 1, 4)]
    assert sums[0] < sums[1] < sums[2]


def test_no_documents(docs):
    assert hmm.score(docs([]), states=2, passes=1).count() == 0
    got = hmm.score(docs([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]), states=2, passes=1).collect()
    assert got and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0 and r["base_score"] == 0 for r in got)
