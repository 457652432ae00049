"""Byte pairs over much text: trained once, in memory in proportion, with the result of the plain definition."""

import random
import tracemalloc
from collections import Counter

import numpy as np
from lexiweave.operators import parse, train


def plain(strings, max_tokens, min_freq=1):
    """(left, right, freq) by counting all pairs anew for each merge."""
    lines, out = [(list(s), n) for s, n in strings], []
    while 256 + len(out) < max_tokens:
        count = Counter()
        for line, n in lines:
            for pair in zip(line, line[1:]):
                count[pair] += n
        best = max(((n, *pair) for pair, n in count.items()), default=(0,))
        if best[0] < min_freq:
            break
        token = 256 + len(out)
        out.append((best[1], best[2], best[0]))
        for line, _ in lines:
            i = 0
            while i < len(line) - 1:
                if (line[i], line[i + 1]) == best[1:]:
                    line[i : i + 2] = [token]
                i += 1
    return out, [line for line, _ in lines]


def test_against_the_plain_definition():
    r = random.Random(1)
    for k in range(300):
        letters = r.choice(["a", "ab", "abc", "abcdef"])
        texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))).encode() for _ in range(r.randrange(0, 8))]
        strings = [(t, r.choice([1, 1, 7]) if k % 2 else 1) for t in texts]
        most, least = r.choice([256, 257, 262, 1 << 16]), r.choice([1, 2, 3])
        want, lines = plain(strings, most, least)
        rows = train.train_bpe(strings, most, least)
        assert [r[1:] for r in rows[256:]] == want
        assert all(r[0] == rows[r[1]][0] + rows[r[2]][0] for r in rows[256:])
        pairs = sorted((a << 32 | b, 256 + i) for i, (a, b, _) in enumerate(want))
        keys, made = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        tokens, ends = parse._replayed(texts, keys, made)
        assert [tokens[a:b].tolist() for a, b in zip(ends, ends[1:])] == lines


def test_memory_in_proportion():
    """Links, places and pairs as objects took some 400 bytes for one of text."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(3_000)]
    strings = [(" ".join(r.choice(words) for _ in range(80)).encode(), 1) for _ in range(600)]
    size = sum(len(s) for s, _ in strings)
    tracemalloc.start()
    rows = train.train_bpe(strings, 1_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 1_000
    assert peak < 150 * size


def test_trained_once(spark):
    """The dictionary is rows, not a plan that trains again whenever it is read or sorted."""
    strings = spark.createDataFrame([(0, "abab"), (1, "abc")], "idx long, s string")
    dictionary = train.bpe_dictionary(strings, 300)
    plan = dictionary.orderBy("token_id")._jdf.queryExecution().toString()
    assert "InArrow" not in plan
    assert [(r["left_id"], r["right_id"], r["freq"]) for r in dictionary.orderBy("token_id").collect()][256:] == plain([(b"abab", 1), (b"abc", 1)], 300)[0]
    assert train.bpe_dictionary(strings.limit(0), 300).count() == 256
