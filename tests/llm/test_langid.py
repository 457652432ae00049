import zlib

import numpy as np
import pytest
from lexiweave.llm import langid
from lexiweave.llm.queries import op9_language_id
from pyspark.sql import functions as F

from .conftest import ODD

WORDS = langid.pieces(langid.VOCABULARY)


IDS = {w: i for i, w in enumerate(WORDS.pieces)}
LONG = ["日本語の文章には空白がなく一つの文が一つの語になる" * 4, "ภาษาไทยเขียนติดกันโดยไม่เว้นวรรคระหว่างคำ" * 2, "x" * 300, "the" * 90, "a" * 61, "a" * 62, "na" * 63]
SOME = ["the", "a", "größe", "internationalisation", "x" * 100, "日本", "!!", *LONG]


def brute(word, p):
    """Natural log of the probability of a whole word with its mark: the sum over all ways to cut it, in exact fractions of powers of two."""
    word = "▁".encode() + word
    ahead, power = [1.0], [0]
    for e in range(1, len(word) + 1):
        parts = [(ahead[s] * p[IDS[word[s:e]]], power[s]) for s in range(max(0, e - WORDS.longest), e) if word[s:e] in IDS]
        top = max(k for _, k in parts)
        m, k = np.frexp(sum(np.ldexp(x, k - top) for x, k in parts))
        ahead.append(float(m))
        power.append(int(k) + top)
    return np.log(ahead[-1]) + power[-1] * np.log(2)


def test_forward_sums_all_segmentations():
    g = np.random.default_rng(0)
    p = g.random((len(WORDS.pieces), 2))
    p /= p.sum(axis=0)
    words = [w.encode() for w in SOME]
    got = langid.Lattice(words, WORDS).logs(langid._lifted(p, WORDS))
    for w, row in zip(words, got):
        for k in range(2):
            assert row[k] == pytest.approx(brute(w, p[:, k]), rel=1e-9)


def test_cutting_a_word_would_leave_segmentations_out():
    """A word's probability isn't the product of its parts'."""
    p = langid.prior(WORDS)
    assert brute(b"the" * 90, p) != pytest.approx(brute(b"the" * 15, p) * 6, abs=0.1)


def test_expected_counts_cover_the_bytes():
    words = [b"hello", b"der", *(w.encode() for w in SOME)]
    weight = np.arange(1.0, len(words) + 1)[:, None]
    counts = langid.Lattice(words, WORDS).expected(langid._lifted(langid.prior(WORDS), WORDS), weight)
    size = sum(n * (3 + len(w)) for w, n in zip(words, weight[:, 0]))
    assert (counts[:, 0] * WORDS.lengths).sum() == pytest.approx(size)


@pytest.mark.parametrize("text", ["ththe", "nanana" * 20, "日本語日本"])
def test_expected_counts_against_all_cuts(text):
    """The expected occurrences of a piece are the derivative of the word's log probability by the log of its own."""
    p = langid.prior(WORDS)
    counts = langid.Lattice([text.encode()], WORDS).expected(langid._lifted(p, WORDS), np.ones((1, 1)))[:, 0]
    for piece in (b"th", b"the", b"na", b"n", "日".encode(), "本".encode()):
        up, down = p.copy(), p.copy()
        up[IDS[piece]] *= 1.0001
        down[IDS[piece]] /= 1.0001
        assert counts[IDS[piece]] == pytest.approx((brute(text.encode(), up) - brute(text.encode(), down)) / (2 * np.log(1.0001)), abs=1e-3)


def test_words_are_dealt_by_number_and_bytes():
    words = [b"a"] * 50_000 + [b"b" * (3 << 20), b"c"]
    runs = list(langid.dealt(words))
    assert [i for i, _ in runs] == [0, *[j for _, j in runs[:-1]]] and runs[-1][1] == len(words)
    assert all(j - i <= 20_000 and (j - i == 1 or sum(map(len, words[i:j])) <= 1 << 20) for i, j in runs)


def test_equal_languages_tie_by_name(docs):
    """Texts that fit two languages alike go to the first by name."""
    df = docs([(i, "one and one") for i in range(12)], lang="xx").unionByName(docs([(i, "one and one") for i in range(12)], lang="bb"))
    got = langid.identify(df).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("bb", 0.5)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def made(docs):
    some = docs([(i, "the cat and the dog of it") for i in range(20)] + [(40, None), (41, "")], lang="en").unionByName(docs([(20 + i, "der hund und die katze ist") for i in range(20)], lang="de"))
    return some.unionByName(docs([(100 + k, t) for k, t in enumerate(ODD)] + [(None, "der hund"), (3, "the dog"), (3, "the dog"), (200, "1234 !!")]))


def test_odd_rows_and_columns(docs):
    df = made(docs).withColumn("score", F.lit("own")).withColumn("id", F.lit(1))
    out = langid.identify(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "held_out", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de") and 0 < r["score"] <= 1
        if r["lang"]:
            assert r["lang_pred"] == r["lang"] or not r["text"]
    kept = langid.with_language(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r["lang_pred"] != "und" for r in rows)


def test_nothing_to_learn_from(docs):
    assert langid.identify(docs([])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs(["some text"])).collect()} == {"und"}
