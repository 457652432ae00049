import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece as library
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiweave.llm import sentencepiece
from pyspark.sql import functions as F

from .conftest import ODD

REAL = library.SentencePieceProcessor(model_file=sentencepiece.VOCABULARY)
WORDS = sentencepiece.vocabulary(sentencepiece.VOCABULARY)
LONG = ["日本語の文章には空白がなく一つの文が一つの語になる" * 6, "x" * 200, "the" * 120, "naïve" + "é" * 70 + "\U0001f600" * 3 + "a" * 64, "=" * 62, "=" * 63, "=" * 64, "\U0001f600" * 200 + "a", "▁" * 90 + "\U0001f9ff" * 70 + "▁" * 70, "a" * 128 + " " + "ab" * 64]
TEXTS = [*ODD, *LONG, "  two  spaces  ", "tab\tnew\nline\r\nend", "▁literal ▁▁ mark", "<s> </s> <unk> <0x0A>", "don't f(x)={}; 3.14 x²”. .”", "Zażółć gęślą jaźń", "x" * 62 + " " + "the" * 40, "a\x00b", " "]


SCORES = {p: REAL.get_score(i) for p, i in WORDS.ids.items()}
FOREIGN = min(SCORES.values()) - 10


def best(unit):
    """The pieces of the path of the best sum of scores, by trying every piece at every place: the last piece of the least id among equals."""
    n = len(unit)
    paths = [(0.0, [])]
    for j in range(1, n + 1):
        found = []
        for i in range(max(0, j - WORDS.longest), j):
            s = unit[i:j]
            if s in WORDS.ids:
                found.append((paths[i][0] + SCORES[s], -WORDS.ids[s], i, [WORDS.ids[s]]))
            elif j - i == 1:
                found.append((paths[i][0] + FOREIGN, -WORDS.size - ord(s), i, [WORDS.bytes[b] for b in s.encode()]))
        total, _, i, ids = max(found, key=lambda x: x[:2])
        paths.append((total, (i, ids)))
    out, j = [], n
    while j:
        i, ids = paths[j][1]
        out = ids + out
        j = i
    return out


def best_ids(text):
    return [i for u in WORDS.units(text or "") for i in best(u)]


@pytest.mark.parametrize("limit", [10**9, -1], ids=["broadcast", "join"])
def test_ids_are_the_best_path_and_decode(docs, limit):
    """Whole texts, units of any length among them."""
    df = docs(TEXTS).withColumn("ids", F.lit("own")).withColumn("key", F.lit(1)).withColumn("block", F.lit(2)).withColumn("h", F.lit(3))
    out = sentencepiece.encode(df, broadcast_units=limit)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "block", "h", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) and all(r["h"] == 3 for r in rows)
    known = {}
    for r in rows:
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
        want = [i for u in WORDS.units(r["text"] or "") for i in (known.get(u) or known.setdefault(u, best(u)))]
        assert r["ids"] == want, r["text"][:40]


@pytest.mark.parametrize("limit", [10**9, -1], ids=["broadcast", "join"])
def test_merges_are_the_librarys(docs, limit):
    for r in sentencepiece.encode(docs(TEXTS), order="merges", broadcast_units=limit).collect():
        assert r["ids"] == REAL.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
    with pytest.raises(ValueError, match="scores or merges"):
        sentencepiece.encode(docs(TEXTS), order="size")


def test_documents_of_all_kinds(spark):
    """Every document of a table, whole, against all paths, and no path of the library's sums up to more."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = {}
    for r in sentencepiece.encode(df).collect():
        units = WORDS.units(r["text"] or "")
        assert r["ids"] == [i for u in units for i in (known.get(u) or known.setdefault(u, best(u)))]
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
        total = lambda ids: sum(map(REAL.get_score, ids))
        assert total(r["ids"]) >= total(REAL.encode(r["text"] or ""))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghij étaoins\n\r\t▁.,;()=0123日本\U0001f600", max_size=60))
def test_fold_is_the_librarys(text):
    ids = [i for u in WORDS.units(text) for i in WORDS.ids_of(WORDS.fold(u))]
    assert ids == REAL.encode(text)
    assert WORDS.decode(ids) == text.replace("▁", " ")


def test_units_join_to_the_text():
    for t in TEXTS:
        if t:
            assert "".join(WORDS.units(t)) == "▁" + t.replace(" ", "▁")


def cut(texts):
    codes, distinct, ends = WORDS.cut(pa.array(texts, pa.string()))
    names = [u.decode().replace(" ", "▁") for u in distinct]
    return [[names[c] for c in codes[a:b]] for a, b in zip(ends, ends[1:])]


def test_texts_are_cut_into_units():
    assert cut(TEXTS) == [WORDS.units(t or "") for t in TEXTS]
    assert cut([]) == [] and cut([None, ""]) == [[], []]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\r\t▁.,(0日\U0001f600", max_size=30), max_size=4))
def test_texts_are_cut_as_the_pattern_says(texts):
    assert cut(texts) == [WORDS.units(t) for t in texts]


def test_decoding_foreign_ids():
    assert WORDS.decode([1, WORDS.bytes[0xFF], 2]) == "�"
    assert WORDS.decode([]) == ""


def test_chunks_overlap_by_the_longest_piece():
    unit = "".join(chr(0x4E00 + i) for i in range(200))
    rows = sentencepiece.chunks(unit, WORDS.longest)
    assert [r[1] for r in rows] == list(range(-(-200 // sentencepiece.CHUNK))) and {r[2:] for r in rows} == {sentencepiece._identity(unit.encode())}
    for part, k, *_ in rows:
        assert part == unit[max(0, sentencepiece.CHUNK * k - WORDS.longest) : sentencepiece.CHUNK * (k + 1)]
    assert sentencepiece.chunks("▁short", WORDS.longest) == [("▁short", 0, None, None)]


def test_hashes_are_sparks(spark):
    for u in ("▁hello", "日本語", "a" * 300, "\U0001f600"):
        r = spark.createDataFrame([(u,)], "u string").select(F.xxhash64("u").alias("h"), F.crc32(F.col("u").cast("binary")).alias("h2")).first()
        assert (r["h"], r["h2"]) == sentencepiece._identity(u.encode())


def test_no_documents(docs):
    assert sentencepiece.encode(docs([])).count() == 0
    assert sentencepiece.encode(docs([]), broadcast_units=-1).count() == 0


def slice_of_words(n):
    """4 MB of texts in one batch, of n distinct words."""
    rng = np.random.default_rng(1)
    words = [" " + "".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n)]
    texts = ["".join(words[j] for j in rng.integers(0, n, 600)) for _ in range(1000)]
    return pa.array(texts, pa.string())


def peak_of(run, batches):
    """Rows, and the peak of what Python and NumPy hold."""
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter(batches)))
        return rows, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture
def functions(spark, monkeypatch):
    """The Arrow functions that plans are made with, as they are made."""
    made, kind = [], type(spark.range(0))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *more: (made.append(run), plain(self, run, *more))[1])
    return made


def test_a_task_cuts_up_little_at_a_time(spark, functions):
    """what a worker holds besides its units to give 4 MB of texts their ids: it took 82 MB."""
    text = slice_of_words(5000)
    docs = spark.createDataFrame(pa.table({"doc_id": range(1000), "text": text}))
    sentencepiece.encode(docs)
    rows, peak = peak_of(functions[-1], [pa.record_batch([pa.array(range(1000)), text], names=["doc_id", "text"])])
    assert rows == 1000
    assert peak < 40e6


def test_units_leave_as_they_are_spelled(spark, functions):
    """250,000 distinct units leave the set one by one: it took 41 MB."""
    rng = np.random.default_rng(2)
    units = ["".join(map(chr, x)) for x in rng.integers(97, 123, (250_000, 10))]
    sentencepiece.distinct_units(spark.createDataFrame([], "text string"), sentencepiece.VOCABULARY)
    batches = [pa.record_batch([pa.array([" ".join(units[i : i + 1000]) for i in range(a, a + 50_000, 1000)])], names=["text"]) for a in range(0, len(units), 50_000)]
    rows, peak = peak_of(functions[-1], batches)
    assert rows == len(set(units))
    assert peak < 32e6


def test_workers_map_the_ids_of_the_units(spark, functions):
    """The pipeline's sentencepiece: each worker held a copy of the ids of all units, here 1.6 MB."""
    rng = np.random.default_rng(3)
    units = ["".join(map(chr, x)) for x in rng.integers(97, 123, (60_000, 10))]
    docs = spark.createDataFrame(pa.table({"doc_id": range(60), "text": [" ".join(units[i : i + 1000]) for i in range(0, 60_000, 1000)]}))
    sentencepiece.encode(docs)
    rows, peak = peak_of(functions[-1], [pa.record_batch([pa.array([1]), pa.array([units[0]])], names=["doc_id", "text"])])
    assert rows == 1
    assert peak < 600e3


def test_pools_are_the_same_mapped_and_copied(spark):
    for sizes in ([], [0], [3, 0, 1], [300, 2] * 30_000):
        lists = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
        units = [str(i).encode() for i in range(len(sizes))]
        pool = sentencepiece.Pool.of(pa.table({"h": pa.array([sentencepiece._identity(u)[0] for u in units], pa.int64()), "ids": lists}))
        table = spark.sparkContext.broadcast(pool.packed())
        mapped, copied = sentencepiece.Pool.shared(table), sentencepiece.Pool.unpacked(pool.packed())
        for a in (mapped, copied):
            assert all(x.flags.aligned for x in (a.keys, a.starts, a.sizes, a.pool))
            n, ids = a(units)
            assert n.tolist() == sizes and ids.tolist() == [i for k in sizes for i in range(k)]
        assert not any(x.flags.owndata or x.flags.writeable for x in (mapped.keys, mapped.starts, mapped.sizes, mapped.pool))
        with pytest.raises(ValueError, match="a unit that it did not have"):
            mapped([b"other"])
        table.destroy()


def test_pieces_come_without_python_workers(spark):
    """The pipeline's sentencepiece: tables of Python lists had a second daemon and workers of their own in each executor."""
    units = spark.createDataFrame(pa.table({"unit": ["▁the"], "chunk": pa.array([0], pa.int32()), "h": pa.nulls(1, pa.int64()), "h2": pa.nulls(1, pa.int64())}))
    plan = sentencepiece.lattice(units, WORDS)._jdf.queryExecution().toString()
    assert "Scan ExistingRDD" not in plan
