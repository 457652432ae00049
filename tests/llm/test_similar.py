import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from lexiweave.llm import similar, simhash
from lexiweave.llm._text import LOWER
from pyspark.sql import functions as F

from .conftest import ODD, words_of
from .test_simhash import roots


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """Ids that stay by comparing all pairs."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    label = roots(len(rows), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    return sorted({rows[i][0] for i in set(label)})


def copies():
    """Texts and copies with one to five words changed: many of similarity 0.8 to 0.95, some just below."""
    out, r = [], random.Random(3)
    for s in range(40):
        w = words_of(s, 60 + s)
        out.append(" ".join(w))
        for changes in range(1, 6):
            v = list(w)
            for k in r.sample(range(len(v)), changes):
                v[k] = f"new{r.random()}"
            out.append(" ".join(v))
    return [*out, *ODD, "A  b\tc", "same " * 5_001]


def test_stage_against_all_pairs(spark, docs):
    rows = list(enumerate(copies()))
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(rows), "").collect())
    assert got == kept(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_on_documents(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == kept([(r["doc_id"], r["text"]) for r in df.collect()])


def test_null_and_repeated_ids(docs):
    text = " ".join(words_of(1, 50))
    rows = [(5, text), (2, text), (2, text), (None, "other words"), (None, "other words"), (4, "a b"), (3, None), (6, " ")]
    df = docs(rows).withColumn("key", F.lit(1))
    out = simhash.keep_one(df, shingle=5, least=(4, 5))
    assert out.columns == df.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect()) == [-1, 2, 3, 4]
    assert simhash.keep_one(docs([]), shingle=5, least=(4, 5)).count() == 0


def test_fingerprints_are_votes_of_the_sets():
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, n, np.uint64)) for i, n in enumerate([1, 7, 300, 0, 1000])]
    got = similar.fingerprints(sets)
    for x, row in zip(sets, got):
        for seed, word in zip(similar._SEEDS, row):
            h = similar._mixed(x ^ seed)
            assert int(word) == sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in h) > len(h))


def test_equal_groups_share_a_bucket():
    groups = similar.bit_groups(1000, 0.8)
    words = np.random.default_rng(0).integers(0, 1 << 63, (6, similar.WORDS), np.uint64)
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    bits[1] = bits[0]
    bits[1, np.setdiff1d(np.arange(bits.shape[1]), groups[9])] ^= 1
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    found = similar.buckets(words, groups)
    assert [k for k in range(len(groups)) if found[0, k] == found[1, k]] == [9]
    assert len(np.unique(found[2:])) == found[2:].size


@pytest.mark.parametrize("least, more", [(0.8, 0.97), (0.9, 0.999)])
def test_share_of_pairs_proposed(least, more):
    """Sets of this similarity share a bucket as often as the README says."""
    g, groups, met = np.random.default_rng(1), similar.bit_groups(200_000, 0.8), 0
    for _ in range(300):
        n = 400
        extra = round(n * (1 - least) / (2 * least))
        both = g.integers(0, 1 << 63, n, np.uint64)
        sets = [np.unique(np.concatenate([both, g.integers(0, 1 << 63, extra, np.uint64)])) for _ in range(2)]
        a, b = similar.buckets(similar.fingerprints(sets), groups)
        met += bool((a == b).any())
    assert met / 300 >= more


@pytest.mark.parametrize("following", [1, 2, 5, 32])
def test_buckets_are_compared_whole(following):
    """Over batches of any size: all pairs of buckets up to the bound, the least with all in hot ones, whose rows come out once each."""
    g = np.random.default_rng(7)
    rows = sorted((int(b), int(k)) for b, n in enumerate([1, 2, 3, following, following + 1, following + 2, 40, 1, 77]) for k in g.permutation(1000)[:n])
    whole = np.array([[b, k, 100, 0, 0] for b, k in rows], np.int64)
    rule = similar.Rule((4, 5))
    run, _ = similar._compared(rule, following)
    for size in (1, 3, 10, 1000):
        batches = [pa.record_batch([pa.array(c) for c in whole[i : i + size].T], names=list("bknvw")) for i in range(0, len(whole), size)]
        out = pa.Table.from_batches(list(run(iter(batches)))).to_pylist()
        got = {(r["a"], r["b"]) for r in out if r["b"] is not None}
        hot = sorted((r["bucket"], r["a"]) for r in out if r["b"] is None)
        want, want_hot = set(), []
        for b in range(9):
            keys = [k for c, k in rows if c == b]
            for i, x in enumerate(keys):
                want |= {(min(x, y), max(x, y)) for y in keys[i + 1 : i + 1 + following]} | {(keys[0], y) for y in keys[1:]}
            want_hot += [(b, k) for k in keys] if len(keys) > following + 1 else []
        assert want <= got and hot == sorted(want_hot)
        assert got <= {(x, y) for b in range(9) for x in [k for c, k in rows if c == b] for y in [k for c, k in rows if c == b] if x < y}


def test_hot_buckets_lose_no_link(docs):
    """With hardly any neighbours compared at first, the second round finds the rest."""
    rows = list(enumerate(copies()))
    df = docs(rows).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")
    known, tree = similar.groups(df, 5, (4, 5), following=1)
    root = {r["node"]: r["root"] for r in tree.collect()}
    ids = {}
    for r in sorted(known.collect(), key=lambda r: r["id"]):
        ids.setdefault(root.get(r["key"], r["key"]), r["id"])
    assert sorted(ids.values()) == kept(rows)
