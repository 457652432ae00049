import random

import numpy as np
import pyarrow as pa
import xxhash
from lexiweave.llm import simhash
from lexiweave.llm._spark import components, forest
from pyspark.sql import functions as F

from .conftest import ODD, words_of

SPACE = b" \t\n\x0b\x0c\r"


def fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, near):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def variants(seed, n):
    r = random.Random(seed)
    base = words_of(seed, 120)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = f"z{r.randrange(99)}"
        out.append(" ".join(w))
    return out


def test_groups_against_brute_force(docs):
    texts = ODD + variants(1, 25) + variants(2, 25) + variants(1, 5) + [" ".join(words_of(s, 40)) for s in range(30)] + ["one two", "One  TWO", "one two three"]
    fps = [fingerprint(t) for t in texts]
    want = roots(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    df = docs(texts).withColumn("fingerprint", F.lit("own")).withColumn("fp", F.lit(3)).withColumn("component_id", F.lit("c"))
    got = {r["doc_id"]: r for r in simhash.groups(df).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == dict(enumerate(fps))
    assert all(len(r["fingerprint"]) == 16 for r in got.values())
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_every_number_of_groups_finds_the_same_links(spark):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 6))) for f in fps for _ in range(4)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert want
    for m in (2, 3, 4, 5, 7):
        assert {tuple(x) for x in simhash.links(df, 4, m).collect()} == want


def test_thresholds_add_up():
    costs = np.random.default_rng(0).random((4, 3, 50))
    t = simhash.allocate(costs, 1)
    assert (t.sum(axis=0) == 1).all()
    best = [min(sum(costs[i, c[i], k] for i in range(4)) for c in np.ndindex(3, 3, 3, 3) if sum(c) == 5) for k in range(50)]
    assert np.allclose([sum(costs[i, t[i, k] + 1, k] for i in range(4)) for k in range(50)], best)


def test_ball_counts():
    h = np.random.default_rng(1).integers(0, 5, 64)
    near = simhash.ball_counts(h, 2)
    for t in range(3):
        assert [sum(h[j] for j in range(64) if (i ^ j).bit_count() <= t) for i in range(64)] == near[t].tolist()


def test_null_and_repeated_ids(docs):
    text = " ".join(words_of(9, 30))
    rows = [(None, text), (4, text), (4, text), (None, "alone here"), (2, "some other words entirely " * 9), (2, "some other words entirely " * 9)]
    got = simhash.groups(docs(rows)).collect()
    assert len(got) == 6
    by = {(r["doc_id"], r["component_id"]) for r in got}
    assert by == {(None, 4), (4, 4), (None, None), (2, 2)}
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in simhash.keep_one(docs(rows)).collect()) == [-1, 2, 4]


def test_clashing_columns(docs):
    rows = [(0, "a b c d e"), (1, "a b c d e"), (1, "A b  c d e"), (2, None), (2, "other words that are here")]
    names = ["__fp", "__copies", "__id", "__lead", "fp", "id", "h", "key", "rows", "root", "node", "none", "f"]
    df = docs(rows)
    for n in names:
        df = df.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    for out in (simhash.keep_one(df), simhash.keep_one(df, shingle=5, least=(4, 5))):
        assert out.columns == df.columns
        got = sorted(out.collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
        assert [(r["doc_id"], r["text"]) for r in got] == [(0, "a b c d e"), (2, None), (2, "other words that are here")]
        assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
    for name in ("fp", "id", "text2", "rows"):
        got = simhash.groups(docs(rows).withColumnRenamed("doc_id", name), id_col=name).collect()
        assert sorted((r[name], r["component_id"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]


def test_many_near_fingerprints_in_one_group(spark):
    """20,000 different fingerprints that are equal in 40 bits: their value is hot, its blocks are compared apart."""
    g = np.random.default_rng(2)
    chain = [0]
    for _ in range(6_000):  # each differs in one bit from some earlier one, and in more than four from most
        chain.append(int(chain[g.integers(max(0, len(chain) - 50), len(chain))]) ^ 1 << int(g.integers(0, 24)))
    far = g.integers(0, 1 << 24, 14_000)
    fps = np.unique(np.concatenate([np.array(chain), far, far ^ (1 << 40)])).astype(np.int64)
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(4)
    got = {r["node"]: r["root"] for r in components(simhash.links(df, 4, hot=512)).collect()}
    heads, tails = [], []
    for i in range(0, len(fps), 500):
        x, y = np.nonzero(np.bitwise_count(fps[i : i + 500, None] ^ fps[None, :]) <= 4)
        heads.append(fps[i : i + 500][x])
        tails.append(fps[y])
    nodes, low = forest(np.concatenate(heads), np.concatenate(tails))
    want = dict(zip(nodes.tolist(), low.tolist()))
    assert {k: v for k, v in got.items() if k != v} == want


def test_frequent_fingerprints_stay_where_they_are(docs, monkeypatch):
    monkeypatch.setattr(simhash, "OFTEN", 3)
    texts = [None, ""] * 10 + ["a b c d e f"] * 10 + ["one two three four", "five six seven eight nine"] * 2
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.groups(docs(texts)).collect())
    assert got == [(i, texts.index(t) if t else 0) for i, t in enumerate(texts)]


def test_lost_rows_that_are_joined(docs, monkeypatch):
    rows = list(enumerate(variants(1, 20) + variants(2, 20)))
    want = sorted(r["doc_id"] for r in simhash.keep_one(docs(rows)).collect())
    monkeypatch.setattr(simhash, "BROADCAST_LOST", -1)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(rows)).collect()) == want


def test_no_documents(docs):
    assert simhash.groups(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0


def test_batches_in_blocks(monkeypatch):
    texts = [" ".join(words_of(s, n)) for s, n in enumerate([1, 3, 4, 700, 5, 0, 90])]
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprints_of(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def test_components_of_long_chains(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + i // 2) for i in range(1, 200)] + [(5, 5), (7, None)]
    r.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {x["node"]: x["root"] for x in components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(df.limit(0)).count() == 0


def test_forest():
    nodes, low = forest(np.array([5, 7, 9, 1]), np.array([7, 9, 5, 2]))
    assert dict(zip(nodes.tolist(), low.tolist())) == {7: 5, 9: 5, 2: 1}
