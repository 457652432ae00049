"""The operators' queries against their SQL, the whole pipeline, and that nothing depends on this subpackage."""

import os
import re

import corpus_pipeline
import pytest
from lexiweave.llm import queries

from ..test_entry import same
from .test_decontam import words
from .test_similar import kept as similar_kept
from .test_substring import brute as repeats

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    same(spark, name)


def test_every_operator_has_a_query():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.queries()] == [str(i) for i in range(1, 11)]


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
        docs = stage(spark, docs, SF).persist()
        after = {r["doc_id"]: r for r in docs.collect()}
        texts = [r[1] for r in before]
        if name == "language_id":
            assert set(after) == {r[0] for r in before if any(c.isalpha() for c in r[1] or "")}
        elif name == "simhash_near_dedup":
            # stages on word shingles take five words and a Jaccard similarity of 0.8 or more
            assert set(after) == set(similar_kept([(r[0], r[1]) for r in before]))
        elif name == "substring_dedup":
            for r, (n, gone, kept) in zip(before, repeats([(r[0], r[1]) for r in before])):
                if n and gone == n:
                    assert r[0] not in after
                else:
                    assert after[r[0]]["text"] == (kept.decode() if gone else r[1])
        elif name == "benchmark_decontamination":
            items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            runs = {tuple(p[i : i + 10]) for p in items for i in range(max(1, len(p) - 9))}
            sizes = {len(r) for r in runs}
            hit = {r[0] for r in before for w in [words(r[1])] if any(tuple(w[i : i + k]) in runs for k in sizes for i in range(len(w) - k + 1))}
            assert set(after) == {r[0] for r in before} - hit
        else:
            assert set(after) == {r[0] for r in before} and all(r["round_trip"] for r in after.values())
        if name != "sentencepiece":
            assert docs.columns == columns


def test_nothing_else_imports_this_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "lexiweave")):
        if not folder.endswith("llm") and "__pycache__" not in folder:
            for f in files:
                assert "lexiweave.llm" not in open(os.path.join(folder, f)).read()
