import re

import pytest
from lexiweave.llm import decontam
from pyspark.sql import functions as F

from .conftest import ODD, words_of

APART = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, " ".join(words_of(1, 30))), (2, " ".join(words_of(2, 10))), (3, "Short, item here"), (4, "one"), (5, " ".join(words_of(1, 30)[5:25])), (6, None), (7, ""), (8, "---"),
    (9, "aa " * 12), (10, "été d'où"), (10, "été d'où"), (None, "words without an id"), (11, " ".join(words_of(3, 9))),
]


def words(text):
    return [x for x in APART.split((text or "").translate(LOWER)) if x]


def brute(text):
    w, hit, items = words(text), set(), set()
    for i, t in ITEMS:
        p = words(t)
        if not p:
            continue
        for s in range(max(1, len(p) - 9)):
            run = p[s : s + 10]
            for k in range(len(w) - len(run) + 1):
                if w[k : k + len(run)] == run:
                    hit.update(range(k, k + len(run)))
                    items.add(None if i is None else str(i))
    return len(w), len(hit), sorted(items, key=lambda x: (x is None, x or ""))


TEXTS = [
    *ODD, "x " + " ".join(words_of(1, 30)) + " y", " ".join(words_of(1, 30)[3:13]).upper(), " ".join(words_of(1, 30)[3:12]), " ".join(words_of(2, 10)) * 2, "a short item here, a short-item-here",
    "one two one", "aa " * 9, "aa " * 10, "aa " * 50, "été d où!", " ".join(words_of(5, 3000)), " ".join(words_of(3, 9)), " ".join(words_of(3, 9)[:8]),
    "some words without an id, one",
]


@pytest.mark.parametrize("block, slab", [(10**6, 10**6), (7, 10**6), (10**6, 100), (5, 200)])
def test_against_brute_force(spark, docs, block, slab):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").repartition(3)
    df = docs(TEXTS).withColumn("spans", F.lit("own")).withColumn("extra", F.lit(1)).withColumn("item", F.lit(2))
    out = decontam.find(df, items, block=block, slab=slab)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "item", "n_words", "n_hit", "item_ids", "spans"]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == brute(t), t
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]


def test_only_clean_documents_stay(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs(TEXTS).withColumn("n_hit", F.lit(5))
    kept = decontam.without_benchmark(df, items)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if not brute(t)[1]]


def test_empty_tables_and_repeats(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontam.find(docs(TEXTS), none).collect()} == {0}
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.find(docs([]), items).count() == 0
    assert [r["n_hit"] for r in decontam.find(docs([(None, "one"), (None, "one")]), items).collect()] == [1, 1]


def test_shifts_never_pass_an_occurrence():
    patterns = {tuple(b"abcabcabca"[i : i + 1] for i in range(10)): {0}, tuple([b"a"] * 10): {1}}
    s = decontam.Searcher(patterns)
    text = [bytes([c]) for c in b"aaaaaaaaaaaabcabcabcabcabcab"]
    starts, items = [], set()
    s.search(text, starts, items)
    assert starts == [i for i in range(len(text) - 9) if tuple(text[i : i + 10]) in patterns] and items == {0, 1}
