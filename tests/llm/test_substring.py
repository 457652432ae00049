import hashlib
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from lexiweave.llm import substring
from pyspark.sql import functions as F

from .conftest import ODD, words_of


def brute(rows, window=20):
    """doc_id, text -> words left; rows that share an id are one document to the comparison."""
    first = {}
    split = [(float("inf") if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passages():
    a, b = " ".join(words_of(1, 60)), " ".join(words_of(2, 35))
    return [
        a, f"before {a} after", f"{b}\n{a}\t{b}", f"x {b} y {b}", " ".join(words_of(1, 60)[:19]), " ".join(words_of(1, 60)[:20]), " ".join(words_of(1, 60)[5:40]),
        "again " * 45, "again " * 19, "again " * 20, f"{a} {a} {a}", *[" ".join(words_of(s, 50)) for s in range(10, 20)], *ODD, a.upper(),
    ]


@pytest.mark.parametrize("bits", [8, 16, None])
def test_against_brute_force(docs, bits):
    texts = passages()
    df = docs(texts).withColumn("n_words", F.lit("own")).withColumn("__id", F.lit(1)).repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in substring.without_repeats(df, bits=bits).collect()}
    assert [got[i] for i in range(len(texts))] == brute(list(enumerate(texts)))


def test_other_columns_stay(docs):
    df = docs(passages()).withColumn("kept", F.lit(2))
    got = substring.without_repeats(df)
    assert got.columns == [*df.columns, "n_words", "n_removed", "kept_text"]
    assert got.select(*df.columns).exceptAll(df).count() == 0


def test_small_blocks_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(substring, "_HELD", 50)
    texts = passages()
    got = {r["doc_id"]: (r["n_removed"]) for r in substring.without_repeats(docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [x[1] for x in brute(list(enumerate(texts)))]


def test_hot_minimizers_go_apart(docs, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 1 << 40)  # whatever comes 64 times in a task is hot
    common = " ".join(words_of(7, 18))
    texts = [f"{' '.join(words_of(s % 150, 12, 10**6))} {common} {' '.join(words_of(-1 - s % 150, 12, 10**6))}" for s in range(200)]
    df = docs(texts).coalesce(1)
    _, hot = substring.repeated_cells(df, "text", 20, 16)
    assert len(hot)
    got = {r["doc_id"]: r["n_removed"] for r in substring.without_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == [x[1] for x in brute(list(enumerate(texts)))]


def test_shared_and_null_ids(docs):
    a = " ".join(words_of(1, 30))
    rows = [(3, a), (3, a), (3, "zz " + a), (None, a), (None, a), (1, "other words"), (5, a)]
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in substring.without_repeats(docs(rows)).collect())
    want = sorted((str(i), t, b[1]) for (i, t), b in zip(rows, brute(rows)))
    assert got == want


def test_sketches_meet_in_steps(docs, monkeypatch):
    """Whatever the steps, the merged sketch is the same."""
    df = docs(passages()).repartition(7)
    want, hot = substring.repeated_cells(df, "text", 20, 16)
    monkeypatch.setattr(substring, "_FAN", 2)
    got, hot2 = substring.repeated_cells(df, "text", 20, 16, 7 * substring._FANNED)
    assert all((a == b).all() for a, b in zip(want, got)) and hot.tolist() == hot2.tolist()


def test_many_rows_of_one_id_and_text(docs):
    """20,000 copies without an id take work in proportion to their number."""
    a = " ".join(words_of(1, 30))
    rows = [(None, a)] * 20_000 + [(1, "x " + a)]
    start = time.perf_counter()
    got = substring.without_repeats(docs(rows)).groupBy("doc_id").agg(F.min("n_removed").alias("least"), F.max("n_removed").alias("most"), F.count("*").alias("n")).collect()
    assert {(r["doc_id"], r["least"], r["most"], r["n"]) for r in got} == {(None, 30, 30, 20_000), (1, 0, 0, 1)}
    assert time.perf_counter() - start < 40


def test_no_documents(docs):
    assert substring.without_repeats(docs([])).count() == 0


def test_digest_of_nothing_left(docs):
    a = " ".join(words_of(1, 20))
    r = substring.without_repeats(docs([a, a])).where("doc_id = 1").select(F.sha2("kept_text", 256).alias("h")).first()
    assert r["h"] == hashlib.sha256(b"").hexdigest()


def test_a_task_holds_its_windows_once():
    """1,048,576 candidate windows of 36 bytes; sorted all at once, with the columns there twice, they took 115 MB."""
    rng, words = np.random.default_rng(1), [f"w{i}" for i in range(20_000)]
    texts = [" ".join(words[j] for j in rng.integers(0, len(words), 2000)) for _ in range(560)]
    batches = [pa.record_batch([pa.array(range(i, i + 10)), pa.array([0] * 10), pa.array(texts[i : i + 10])], names=["__id", "__tk", "__text"]) for i in range(0, len(texts), 10)]
    every = [np.full(1 << 13, 255, np.uint8)] * 2, np.empty(0, np.uint64)  # a sketch that lets all windows through
    table = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda run, _: run)
    table.select = lambda *_: table
    run = substring._candidates(table, 20, 16, every)
    tracemalloc.start()
    try:
        got = sum(len(b.column("windows").flatten()) for b in run(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == 560 * 1981
    assert peak < 80e6
