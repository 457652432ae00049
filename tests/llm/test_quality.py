import random
import zlib

import numpy as np
import pyarrow as pa
from lexiweave.llm import quality
from lexiweave.llm.queries import op7_quality_classifier
from pyspark.sql import functions as F

from .conftest import ODD

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op7_quality_classifier(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def made(docs, spark, odd=True):
    r = random.Random(0)
    texts = [(i, " ".join(r.choice(["good", "fine", "sound"]) if i % 3 else r.choice(["$$$", "@@@", "spam!!"]) for _ in range(20))) for i in range(90)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(90)] + [(1, 1, 0), (3, None, 0), (None, 1, 1), (6, 7, 0)]
    return docs(texts + ([(100 + k, t) for k, t in enumerate(ODD)] + [(None, "good fine"), (5, "good"), (5, "good")] if odd else [])), spark.createDataFrame(labels, LABELS)


def test_odd_rows_and_columns(docs, spark):
    df, labels = made(docs, spark)
    df = df.withColumn("score", F.lit("own")).withColumn("label", F.lit(1)).withColumn("id", F.lit(2))
    out = quality.score(df, labels)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == df.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 90 and r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held if r["doc_id"] != 5)


def test_joined_labels_give_the_same(docs, spark, monkeypatch):
    df, labels = made(docs, spark, odd=False)
    a = {r["doc_id"]: r["score"] for r in quality.score(df, labels).collect()}
    monkeypatch.setattr(quality, "BROADCAST_LABELS", 0)
    assert a == {r["doc_id"]: r["score"] for r in quality.score(df, labels).collect()}


def test_without_labels_or_documents(docs, spark):
    df, labels = made(docs, spark)
    none = labels.limit(0)
    assert len({r["score"] for r in quality.score(df, none).collect()}) == 1
    assert quality.score(docs([]), labels).count() == 0
    one = labels.where("quality = 1")
    assert {r["predicted"] for r in quality.score(df, one).collect()} == {1}


def test_descent_parts_what_can_be_parted():
    g = np.random.default_rng(0)
    x = g.normal(size=(200, 6))
    signs = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    rows = [(np.arange(6), v) for v in x]
    w = quality.descend(rows, signs, 6, bound=10.0, passes=200)
    assert ((x @ w[:-1] + w[-1] > 0) == (signs > 0)).mean() > 0.98


def test_cells_are_distinct():
    for grams, shape in quality.features(pa.array(["aaaa bbbb aaaa", "", None, "x"])):
        assert len(set(grams.tolist())) == len(grams)
        assert all(quality.DIMENSIONS <= s < quality.DIMENSIONS + quality.SHAPE for s in shape)


def brute_cells(text):
    """A text's distinct cells, from its bytes one by one."""
    data = (text or "").encode().translate(quality.LOWER)
    grams = {((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x9E3779B97F4A7C15) % (1 << 64) >> 46 for i in range(len(data) - 2)}
    words = data.split()
    codes = np.array([sorted(set(words)).index(w) for w in words], np.int64)
    return sorted(grams), quality.shape_of(codes)


def test_query_against_brute_force(docs, spark):
    """Counts, ratios and the hinge-loss model's optimum worked out anew, without the operator's own code but the shape's cells."""
    df, labels = made(docs, spark)
    size = quality.DIMENSIONS + quality.SHAPE
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    marks = {}
    for r in labels.collect():
        if r["quality"] in (0, 1) and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            marks[r["doc_id"]] = max(marks.get(r["doc_id"], 0), r["quality"])
    learnt = [(brute_cells(t), marks[i]) for i, t in rows if i in marks]
    counts = np.ones((2, size))
    for (grams, shape), y in learnt:
        for c in [*grams, *shape]:
            counts[y, c] += 1
    ratio = np.zeros(size)
    for part in (slice(0, quality.DIMENSIONS), slice(quality.DIMENSIONS, size)):
        p, q = counts[1, part], counts[0, part]
        ratio[part] = np.log(p / p.sum()) - np.log(q / q.sum())
    got, ones, zeroes = quality.log_ratios(df.join(spark.createDataFrame(list(marks.items()), "doc_id long, label int"), "doc_id").select("text", "label"))
    assert (ones, zeroes) == (sum(y for _, y in learnt), sum(1 - y for _, y in learnt))
    assert np.allclose(got, ratio)

    def vector(grams, shape):
        x = np.zeros(size + 1)
        x[grams] = ratio[grams] / np.sqrt(max(1, len(grams)))
        x[shape] = ratio[shape] * 0.35
        x[-1] = 1
        return x

    used = sorted({c for (g, s), _ in learnt for c in [*g, *s]} | {size})
    x = np.stack([vector(*cells)[used] for cells, _ in learnt])
    y = np.array([1.0 if label else -1.0 for _, label in learnt])
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(len(y))
    for _ in range(4000):  # projected gradient on the dual: least 1/2 a'Ga - sum a, 0 <= a <= 1
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, 1)
    best = x.T @ (alpha * y)
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()
    coefficient, bias = quality.fit(df.join(spark.createDataFrame(list(marks.items()), "doc_id long, label int"), "doc_id").select(F.col("doc_id").alias("id"), "text", "label"))
    w = np.append(np.divide(coefficient, ratio, out=np.zeros(size), where=ratio != 0), bias)[used]
    assert loss(w) <= loss(best) * 1.02 + 1e-6
    for r in quality.score(df, labels).collect():
        margin = sum(coefficient[c] for c in brute_cells(r["text"])[0]) / np.sqrt(max(1, len(brute_cells(r["text"])[0]))) + 0.35 * sum(coefficient[c] for c in brute_cells(r["text"])[1]) + bias
        want = 1 / (1 + np.exp(-np.clip(3 * margin + np.log(0.7 / 0.3), -30, 30)))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(margin >= 0)


def test_the_fitting_task_gets_cells(docs, spark):
    """Rows that are sampled go to the task as numbers, as many as there are cells at most."""
    df, labels = made(docs, spark, odd=False)
    rows = df.join(labels.where("quality in (0, 1)"), "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("quality").alias("label"))
    whole, part = quality.fit(rows), quality.fit(rows, 30)
    assert whole[0].shape == part[0].shape == (quality.DIMENSIONS + quality.SHAPE,)
    assert np.isfinite(part[0]).all() and (whole[0] != part[0]).any()
