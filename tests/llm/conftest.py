import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def words_of(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


#: Texts with what the operators must bear: none, empty, white space alone, punctuation alone, one word, non-ASCII, very long, all one word.
ODD = [None, "", " \t\n\x0b\x0c\r ", "!!! --- ...", "word", "Ünïcödé 日本語 \U0001f600 É", "x" * 30_000, "same " * 5_000, "a b c", "The MIT License, the mit-license; Apache License. GENERAL PUBLIC LICENSE"]


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text) pairs or texts."""

    def make(rows, **other):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, other.get("lang"), "s", len(t) if t is not None else None) for i, t in rows], DOCS)

    return make
