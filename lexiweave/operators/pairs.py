"""Adjacent-pair statistics, and merges of the most frequent pair by set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.bytes import token_string, tokens_of


def distinct_tokens(strings: DataFrame) -> DataFrame:
    """(t, n): distinct strings as fixed-width base tokens, and how often each occurs. Pairs never cross strings, so counts may be weighted."""
    return strings.where(F.octet_length("s") > 0).groupBy(token_string("s").alias("t")).agg(F.count("*").alias("n"))


def pair_counts(tokens: DataFrame) -> DataFrame:
    """(pair, cnt) over (t, n): overlapping occurrences count, as in aaa, which has (a,a) twice."""
    at = F.sequence(F.lit(0), F.floor(F.length("t") / 5).cast("int") - 2)
    pairs = tokens.where(F.length("t") >= 10).select("n", F.explode(F.transform(at, lambda i: F.substring(F.col("t"), i * 5 + 1, F.lit(10)))).alias("pair"))
    return pairs.groupBy("pair").agg(F.sum("n").alias("cnt"))


def ids_of_pair(df: DataFrame) -> DataFrame:
    """pair as left_id, right_id."""
    half = lambda a: F.conv(F.substring("pair", a, 4), 16, 10).cast("int")
    return df.select(half(2).alias("left_id"), half(7).alias("right_id"), *[c for c in df.columns if c != "pair"])


def top_pairs(strings: DataFrame, k: int) -> DataFrame:
    """The k most frequent pairs (left_id, right_id, cnt); among equals the largest ids come first."""
    return ids_of_pair(pair_counts(distinct_tokens(strings)).orderBy(F.desc("cnt"), F.desc("pair")).limit(k))


def frequent_pairs(strings: DataFrame, threshold: int) -> DataFrame:
    return ids_of_pair(pair_counts(distinct_tokens(strings)).where(F.col("cnt") >= threshold))


def merge_rounds(strings: DataFrame, rounds: int) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """Rounds of merging the most frequent pair everywhere: the strings' last tokens (t, n), and (token_id, left_id, right_id, freq) of the rounds.

    Each round is one aggregation; only its best pair reaches the driver.
    `replace` takes occurrences from the left without overlap.
    """
    now = distinct_tokens(strings).persist()
    merges, tokens = [], now
    for token in range(256, 256 + rounds):
        best = pair_counts(tokens).agg(F.max(F.struct("cnt", "pair")).alias("b")).first()["b"]
        if best is None:
            break
        merges.append((token, int(best["pair"][1:5], 16), int(best["pair"][6:10], 16), best["cnt"]))
        tokens = tokens.withColumn("t", F.replace("t", F.lit(best["pair"]), F.lit(f"x{token:04X}")))
    now.unpersist()
    return tokens, merges


def encode_rounds(strings: DataFrame, merges: list[tuple[int, int, int, int]]) -> DataFrame:
    """(idx, tokens) after the merges, in their order."""
    t = token_string("s")
    for token, left, right, _ in merges:
        t = F.replace(t, F.lit(f"x{left:04X}x{right:04X}"), F.lit(f"x{token:04X}"))
    return strings.select("idx", tokens_of(t).alias("tokens"))
