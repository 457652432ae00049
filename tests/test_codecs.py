"""Codecs against golden vectors, and their properties."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiweave.operators import decode, parse, train
from lexiweave.operators.positions import token_positions
from lexiweave.plans.codecs import CODECS, codec

SAMPLE = ["lamp-0770", "desk-4412", "lamp-7700", "vase-0077"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "idx long, s string")


def rows(df, column):
    return [r[column] for r in df.orderBy("idx").collect()]


def online(texts, threshold=2, max_tokens=1 << 13, max_len=None):
    made = train.train_online([t.encode() for t in texts], threshold, max_tokens, max_len)
    tokens = [r[0] for r in made]
    return tokens[256:], [train.Matcher(tokens).parse(t.encode()) for t in texts]


def bpe(texts):
    from collections import Counter

    return [(r[0], r[3]) for r in train.train_bpe([(t.encode(), n) for t, n in Counter(texts).items()], 1 << 16)[256:]]


@pytest.mark.parametrize("texts, tokens, encoded", [
    (["aaa"], [b"aa"], [[256, 97]]),
    (["aaaa"], [b"aa"], [[256, 256]]),
    (["abab", "ab"], [b"ab"], [[256, 256], [256]]),
    (["ab", "b", ""], [], [[97, 98], [98], []]),
    (["日日", "日本"], [b"\xe6\x97", "日".encode()], [[257, 257], [257, 230, 156, 172]]),
    (["abcabcabcabcabcabc"], [b"ab", b"abc", b"abcabc"], [[258, 258, 258]]),
    (SAMPLE, [b"la", b"mp", b"77", b"-0"], [[256, 257, 259, 258, 48], [100, 101, 115, 107, 45, 52, 52, 49, 50], [256, 257, 45, 258, 48, 48], [118, 97, 115, 101, 259, 48, 258]]),
])
def test_online_pass_in_input_order(texts, tokens, encoded):
    assert online(texts) == (tokens, encoded)


def test_online_pass_keeps_to_the_longest_token():
    assert online(["abcabcabcabcabcabc"], max_len=4) == ([b"ab", b"abc"], [[257] * 6])


def test_online_pass_stops_when_the_dictionary_is_full():
    tokens, _ = online(["abcabcabcabcabcabc"], max_tokens=257)
    assert tokens == [b"ab"]


@pytest.mark.parametrize("texts, merges", [
    (["aaa"], [(b"aa", 2), (b"aaa", 1)]),
    (["aaaa"], [(b"aa", 3), (b"aaaa", 1)]),
    (["abab", "ab"], [(b"ab", 3), (b"abab", 1)]),
    (["ab", "b", ""], [(b"ab", 1)]),
])
def test_byte_pairs(texts, merges):
    assert bpe(texts) == merges


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abc", max_size=14), min_size=1, max_size=8), st.text("abcd", max_size=30))
def test_merges_replay_in_their_order(spark, texts, other):
    """Each merge in turn, everywhere from the left: for strings that were trained on and for others."""
    rows_ = train.train_bpe([(t.encode(), 1) for t in set(texts)], 1 << 16)
    merges = [(i, r[1], r[2]) for i, r in enumerate(rows_) if r[1] is not None]
    want = []
    for t in [*texts, other]:
        tokens = list(t.encode())
        for token, left, right in merges:
            out, i = [], 0
            while i < len(tokens):
                if tokens[i : i + 2] == [left, right]:
                    out.append(token)
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        want.append(tokens)
    assert rows(parse.replay(frame(spark, [*texts, other]), merges), "tokens") == want


def test_byte_pairs_inside_characters():
    assert [t.hex() for t, _ in bpe(["日日", "日本"])] == ["e697", "e697a5", "e697a5e697a5", "e697a5e6", "e697a5e69c", "e697a5e69cac"]


def test_byte_pairs_of_the_sample(spark):
    assert bpe(SAMPLE)[:6] == [(b"77", 3), (b"770", 2), (b"p-", 2), (b"mp-", 2), (b"la", 2), (b"lamp-", 2)]
    s = frame(spark, SAMPLE)
    model = codec("bpe").fit(s)
    encoded = model.encode(s)
    assert rows(encoded, "tokens") == [[265], [280], [263], [272]]
    assert model.space_used(encoded).first()["space_bytes"] == 1521


def test_space_of_packed_ids(spark):
    s = frame(spark, SAMPLE)
    model = codec("pairs13", seed=None).fit(s)
    assert model.space_used(model.encode(s)).first()["space_bytes"] == 43 + 264 + 1044


@pytest.mark.parametrize("name", list(CODECS))
@pytest.mark.parametrize("texts", [[], [""], ["a"], ["", "x", ""], ["a" * 5000], SAMPLE * 3, ["日本語", "日本", "é", "é", "\U0001f600" * 9, ""]], ids=str)
def test_every_codec_gives_the_strings_back(spark, name, texts):
    s = frame(spark, texts)
    model = codec(name).fit(s)
    encoded = model.encode(s)
    assert rows(model.decode(encoded), "s") == texts
    if texts:
        asked = spark.createDataFrame([(q, (q * 7) % len(texts)) for q in range(9)], "qid long, idx long")
        assert {(r["qid"], r["idx"], r["s"]) for r in model.lookup(encoded, asked).collect()} == {(q, (q * 7) % len(texts), texts[(q * 7) % len(texts)]) for q in range(9)}
    if name == "pairs13":
        assert rows(model.unpack(model.pack(encoded), token_positions(encoded)), "tokens") == rows(encoded, "tokens")


def test_seeded_training_repeats(spark):
    s = frame(spark, [f"item-{i % 37}-{i}" for i in range(500)])
    assert codec("pairs").fit(s).tokens == codec("pairs").fit(s).tokens
    assert all(len(t) <= 16 for t in codec("pairs16").fit(s).tokens)


@pytest.mark.parametrize("seed", [None, 42])
def test_first_bytes_do_not_change_the_dictionary(spark, seed):
    """The pass is tried on ever more of the strings until the dictionary is full: it is that of a pass over all."""
    s = frame(spark, [f"item-{i % 37}-{i * 7919 % 1000}" for i in range(1500)]).repartition(3)
    for most in (270, 400, 1 << 16):
        want = codec("pairs", seed=seed, max_tokens=most).fit(s).tokens
        assert len(want) <= most and (most != 270 or len(want) == most)
        for first in (1, 100, 5000):
            assert codec("pairs", seed=seed, max_tokens=most, first_bytes=first).fit(s).tokens == want


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 30, "", "c" * 5, "d"])], names=["idx", "s"])
    cut = [b.column(0).to_pylist() for b in parse.slices([batch], limit=12)]
    assert cut == [[0, 1], [2], [3, 4, 5]]
    lists = pa.record_batch([pa.array([[1] * 5, [], [1] * 9, [1], [1]])], names=["tokens"])
    assert [b.num_rows for b in decode._parts(lists, 0, 6)] == [2, 1, 2]


def test_unknown_codec():
    with pytest.raises(ValueError, match="unknown codec"):
        codec("zip")


def test_encoded_literal_selects_equal_strings(spark):
    s = frame(spark, SAMPLE)
    for name in ("bpe", "pairs"):
        model = codec(name).fit(s)
        wanted = model.encode_literal("lamp-7700")
        assert [r["idx"] for r in model.encode(s).collect() if r["tokens"] == wanted] == [2]


def test_every_way_to_decode_agrees(spark):
    texts = ["日本語日本", "", "é", "aaaa" * 50, "日本"]
    s = frame(spark, texts)
    model = codec("pairs", threshold=2).fit(s)
    encoded = model.encode(s)
    for back in (decode.decode(encoded, model.dictionary), decode.decode_relational(encoded, model.dictionary), decode.decode_arrow(encoded, model.tokens)):
        assert rows(back, "s") == texts


def test_native_parse_agrees(spark):
    texts = ["old gear old gear", "", "gear", "red old bolt", "x", "old gear old gear"]
    s = frame(spark, texts)
    model = codec("pairs16", threshold=2).fit(s)
    assert rows(parse.parse_native(s, model.dictionary), "tokens") == rows(model.encode(s), "tokens")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", max_size=12), max_size=12))
def test_online_properties(texts):
    made = [r[0] for r in train.train_online([t.encode() for t in texts], 2, 1 << 13)]
    assert len(set(made)) == len(made)
    matcher, known = train.Matcher(made), set(made)
    for t in texts:
        data, at = t.encode(), 0
        for token in matcher.parse(data):
            size = len(made[token])
            assert data[at : at + size] == made[token]
            assert not any(data[at:end] in known for end in range(at + size + 1, len(data) + 1))
            at += size
        assert at == len(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=10), min_size=1, max_size=8))
def test_byte_pairs_by_recounting(texts):
    """The heap's merges are those of counting anew in every round."""
    words = [list(t.encode()) for t in texts]
    tokens, want = [bytes([b]) for b in range(256)], []
    while True:
        counts = {}
        for w in words:
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + 1
        if not counts:
            break
        n, (a, b) = max((n, p) for p, n in counts.items())
        tokens.append(tokens[a] + tokens[b])
        want.append((tokens[-1], n))
        for k, w in enumerate(words):
            out, i = [], 0
            while i < len(w):
                if w[i : i + 2] == [a, b]:
                    out.append(len(tokens) - 1)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            words[k] = out
    assert bpe(texts) == want
