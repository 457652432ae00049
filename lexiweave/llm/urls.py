"""URL filter: a blocked Bloom filter before an exact join with the listed rules. DataFrame functions only.

A rule is a host and a path; it fits the host itself and its subdomains where
the url's path starts with the rule's. A url's candidates are the ends of its
host with as many labels as some rule's host has, each with the beginnings of
its path that are as long as some rule's path: their number is bounded by the
list, not by the url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 16 bits in a block of the filter; a key sets one bit in each.
WORDS = 8
#: Keys for each block when the filter is sized.
KEYS = 8
#: Most blocks: a filter of 16 MB. A fuller filter passes more false hits to the join, which removes them.
MOST_BLOCKS = 1 << 20
#: Rules up to which the join broadcasts the list; a longer list is joined by shuffle.
BROADCAST_RULES = 200_000
#: Shapes of rules (labels of a host by length of a path) up to which each hit has a join of its own.
JOINS = 16
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: str, word: int) -> str:
    """SQL for the bit of a key in a word of its block, 0 to 15."""
    return f"cast(shiftrightunsigned(xxhash64({key}, 'bits'), {4 * word}) & 15 as int)"


def bloom(keys: DataFrame, blocks: int) -> bytes:
    """The filter over keys (column `key`): `blocks` blocks of WORDS big-endian words. At most MOST_BLOCKS rows come to the driver."""
    rows = keys.select(_block(F.col("key"), blocks).alias("block"), *[F.expr(f"shiftleft(1, {_bit('key', w)})").alias(f"w{w}") for w in range(WORDS)])
    out = bytearray(blocks * 2 * WORDS)
    for r in rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]).toLocalIterator():
        at = r["block"] * 2 * WORDS
        out[at : at + 2 * WORDS] = b"".join(r[f"w{w}"].to_bytes(2, "big") for w in range(WORDS))
    return bytes(out)


def _with_hits(urls: DataFrame, keys: str, filter_: bytes, blocks: int) -> DataFrame:
    """urls with `hits`: those of the array column `keys` that the filter may hold. A test reads the key's block alone."""
    bits = F.lit(filter_)

    def held(key: Column) -> Column:
        block = F.hex(F.substring(bits, _block(key, blocks) * (2 * WORDS) + 1, F.lit(2 * WORDS)))
        hashed = F.xxhash64(key, F.lit("bits"))
        every = F.lit(True)
        for w in range(WORDS):
            word = F.conv(F.substring(block, 4 * w + 1, 4), 16, 10).cast("int")
            bit = F.shiftrightunsigned(hashed, 4 * w).bitwiseAND(F.lit(15)).cast("int")
            every = every & (F.call_function("getbit", word, bit) == 1)
        return every

    return urls.withColumn("hits", F.filter(F.col(keys), held))


def _keys(labels: list[int], lengths: list[int], listed: bool) -> Column:
    """The candidates of a url as keys: an expression for each shape where they are few, else a loop over both lists."""
    count, size = F.size(F.split("__host", r"\.")), F.length("__path")
    if listed:
        ends = [F.when(count >= k, F.substring_index("__host", ".", -k)) for k in sorted(labels)]
        starts = [F.when(size >= n, F.substring("__path", 1, n)) for n in sorted(lengths)]
        return F.array_compact(F.array(*[F.concat(h, F.lit("\n"), p) for h in ends for p in starts]))
    sides = [F.array(*[F.lit(x) for x in sorted(side)]) for side in (labels, lengths)]
    end = lambda k: F.call_function("substring_index", F.col("__host"), F.lit("."), -k)
    return F.flatten(F.transform(F.filter(sides[0], lambda k: k <= count), lambda k: F.transform(F.filter(sides[1], lambda n: n <= size), lambda n: F.concat(end(k), F.lit("\n"), F.substring("__path", F.lit(1), n)))))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", joins: int = JOINS) -> DataFrame:
    """pages with columns host, path, rule and verdict added (or replaced, if pages has such columns).

    rules: (host, path, verdict), hosts in lower case. Of the rules that fit,
    the one with the longest host and path together wins; among equals the
    longer host, then `allow`. rule is its host and path as one string, null if
    none fits; then the verdict is `otherwise`. Null urls and urls without ://
    have an empty host, which no rule fits. Rules with a null or without a host
    count for nothing and repeated rules are one; with no rules every url gets
    `otherwise`. Repeated rows are judged alike; other columns stay.
    """
    listed = rules.where("host is not null and host <> '' and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("rule_verdict")).withColumn("key", F.concat("host", F.lit("\n"), "path"))
    shape = listed.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url}`"))
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), host.alias("__host"), path.alias("__path"))
    if not shape["n"]:
        return base.select("__row.*", F.col("__host").alias("host"), F.col("__path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    blocks = min(MOST_BLOCKS, max(1, -(-shape["n"] // KEYS)))
    filter_ = bloom(listed, blocks)
    shapes = len(shape["labels"]) * len(shape["lengths"])
    exact = listed.select("key", F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("of_host"), (F.col("rule_verdict") == "allow").alias("allows"), F.concat("host", "path").alias("rule"), "rule_verdict").alias("hit"))
    few = shape["n"] <= BROADCAST_RULES and shapes <= joins
    probed = _with_hits(base.withColumn("keys", _keys(shape["labels"], shape["lengths"], shapes <= joins)), "keys", filter_, blocks).drop("keys")
    own_columns = ("__row", "__host", "__path")
    if few:  # a row's hits meet the list one after the other, where the row is
        out = probed
        for k in range(shapes):
            out = out.withColumn(f"__k{k}", F.get("hits", F.lit(k))).join(F.broadcast(exact.select(F.col("key").alias(f"__k{k}"), F.col("hit").alias(f"__h{k}"))), f"__k{k}", "left").drop(f"__k{k}")
        found = [F.col(f"__h{k}") for k in range(shapes)]
        out = out.select((F.greatest(*found) if shapes > 1 else found[0]).alias("hit"), *own_columns)
    else:  # rows without a hit stay where they are
        clear = probed.where(F.size("hits") == 0).select(F.lit(None).cast(exact.schema["hit"].dataType).alias("hit"), *own_columns)
        met = probed.where(F.size("hits") > 0).withColumn("__n", F.monotonically_increasing_id()).withColumn("key", F.explode("hits")).drop("hits")
        met = met.join(F.broadcast(exact) if shape["n"] <= BROADCAST_RULES else exact, "key", "left")
        out = met.groupBy("__n").agg(F.max("hit").alias("hit"), *[F.first(c).alias(c) for c in own_columns]).drop("__n").unionByName(clear)
    return out.select("__row.*", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("hit.rule").alias("rule"), F.coalesce("hit.rule_verdict", F.lit(otherwise)).alias("verdict"))
