"""SimHash near-duplicates: fingerprints, and links found by the generalised pigeonhole.

The 64 bits are dealt into m groups of correlated bits. If two fingerprints
differ in at most D bits and thresholds t_1..t_m (each -1 or more) add up to
D - m + 1, they differ in at most t_i bits in some group i. Each fingerprint
chooses its own thresholds by dynamic programming on the number of candidates
that they are estimated to bring, probes the values within t_i bits of its own
in group i, and verifies what it meets there.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.llm._spark import bounded_batches, by_place, components, drop_stored, forest, stored
from lexiweave.llm._text import LOWER, bytes_of, pieces_of, trimmed

SHINGLE = 4
SEED = 42
BITS = 64
#: Cells of a group's histogram, as a power of two; wider groups are estimated from as many of their bits.
CELL_BITS = 16
#: A probe is a row to shuffle and sort, a candidate one comparison inside the join: so many of these cost as much.
PROBE = 100
_BLOCK = 1 << 17
#: Each byte's bits as the bytes of a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0].copy()
#: A cell of more fingerprints than this (and than eight times the mean) is hot: its entries are salted into blocks of so many, its probes into _WIDE such blocks.
HOT = 1024
_WIDE = 64
#: Rows of a fingerprint from which on it isn't joined but broadcast: more than so many, and than a ten-thousandth of all, so there are at most 10,000 of them.
OFTEN = 10_000
#: Rows that go, up to which they are broadcast (16 bytes each, and their ids); more are joined.
BROADCAST_LOST = 1_000_000


def bit_votes(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many hashes of each row have each bit set: rows are h[ends[i] : ends[i + 1]].

    The bits of a byte are spread over the bytes of a word, so that a word adds
    up eight counts; runs of 255 hashes can't overflow them.
    """
    lengths = np.diff(ends)
    out = np.zeros((len(lengths), BITS), np.int64)
    runs = -(-lengths // 255)
    row = np.repeat(np.arange(len(lengths)), runs)
    start = ends[row] + 255 * (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs))
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(start, start[a] + _BLOCK, side="right")) - 1)
        end = int(start[b]) if b < len(row) else int(ends[-1])
        spread = _SPREAD[h[start[a] : end].view(np.uint8).reshape(-1, 8)]
        counts = np.add.reduceat(spread, start[a:b] - start[a], axis=0).view(np.uint8)
        rows, first = np.unique(row[a:b], return_index=True)
        out[rows] += np.add.reduceat(counts, first, axis=0, dtype=np.int64)
        a = b
    return out


def majority(votes: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """A bit is set that more than half of the hashes have, as uint64."""
    return np.packbits(votes * 2 > totals[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints_of(text: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text (null: of no words) over its word shingles, repeats included, as uint64."""
    data, ends = bytes_of(text)
    data = data.translate(LOWER)
    digest, hashes, totals = xxhash.xxh64_intdigest, [], []
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
        words = data[i:j].split()
        n = max(1, len(words) - shingle + 1) if words else 0
        totals.append(n)
        if not words:
            continue
        joined = b" ".join(words)
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        a = np.concatenate([[0], after[: n - 1]]).tolist()
        b = (after[min(shingle, len(words)) - 1 :] - 1).tolist()
        hashes.append(np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b)), np.uint64, n))
    totals = np.array(totals, np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return majority(bit_votes(h, np.concatenate([[0], np.cumsum(totals)])), totals)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with a column `name` (long) in place of any of that name: the fingerprint's 64 bits."""
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != name]
    at = rest.index(text)
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(name, T.LongType())])
    names = [*rest, name]

    def run(batches):
        for batch in pieces_of(batches, at):
            fp = pa.array(fingerprints_of(batch.column(at), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], names=names)

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(trimmed(run), schema)


def bit_groups(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near equal width; each grows by the bit that is most correlated with it."""
    left, groups = set(range(len(correlation))), []
    strength = np.abs(correlation) - np.eye(len(correlation))
    for i in range(m):
        width = len(left) // (m - i)
        seed = max(left, key=lambda b: (strength[b, sorted(left)].sum(), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < width:
            best = max(left, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(group)
    return groups


def group_count(n: int, distance: int) -> int:
    """The number of groups with the least probes and expected candidates for n fingerprints, were they random."""
    def cost(m: int) -> float:
        spare = max(0, distance - m + 1)
        total = 0.0
        for i in range(m):
            width = (BITS + i) // m
            probes = sum(comb(width, k) for k in range(spare // m + (i < spare % m) + 1))
            total += probes * (PROBE + n / 2.0**width)
        return total

    return min(range(2, distance + 2), key=cost)


def values_of(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, packed."""
    out = np.zeros(len(fps), np.uint64)
    for k, bit in enumerate(group):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def masks(width: int, flips: int) -> np.ndarray:
    """All masks that flip at most so many of the bits."""
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(width), k)], np.uint64)


def ball_counts(histogram: np.ndarray, most: int) -> np.ndarray:
    """[t, cell]: how many fingerprints lie within t bits of the cell, t from 0 to most."""
    bits = int(log2(len(histogram)))
    shells = [histogram.astype(np.float64)] + [np.zeros(len(histogram)) for _ in range(most)]
    cells = np.arange(len(histogram))
    for b in range(bits):  # each bit is flipped or not
        for t in range(most, 0, -1):
            shells[t] = shells[t] + shells[t - 1][cells ^ (1 << b)]
    return np.cumsum(shells, axis=0)


def allocate(costs: np.ndarray, spare: int) -> np.ndarray:
    """costs[i, t+1, row] for group i at threshold t from -1; the cheapest t of each group and row that add up to `spare`.

    The dynamic programme's state is the sum of t+1 over the groups so far.
    """
    m, levels, n = costs.shape
    goal = spare + m
    best = np.full((goal + 1, n), np.inf)
    best[0] = 0
    chosen = []
    for i in range(m):
        new = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, np.int8)
        for s in range(goal + 1):
            for t in range(min(levels - 1, s) + 1):
                c = best[s - t] + costs[i, t]
                better = c < new[s]
                new[s][better] = c[better]
                pick[s][better] = t
        best = new
        chosen.append(pick)
    out, state, rows = np.zeros((m, n), np.int64), np.full(n, goal), np.arange(n)
    for i in reversed(range(m)):
        out[i] = chosen[i][state, rows]
        state = state - out[i]
    return out - 1


def _bit_sums(batches):
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 1 << 16):
            bits = np.unpackbits(fps[i : i + (1 << 16)].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
    if n:
        yield pa.record_batch([pa.array(range(BITS), pa.int32()), pa.array(list(total)), pa.array([n] * BITS, pa.int64())], names=["bit", "sums", "n"])


def correlation_of(fps: DataFrame) -> tuple[np.ndarray, int]:
    """Correlation of the 64 bits over all fingerprints (64 x 64, so the driver can hold it), and their number."""
    sums = fps.select("fp").mapInArrow(_bit_sums, "bit int, sums array<double>, n long").groupBy("bit").agg(
        *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(BITS)], F.sum("n").alias("n")).orderBy("bit").collect()
    if not sums:
        return np.zeros((BITS, BITS)), 0
    n = sums[0]["n"]
    both = np.array([[r[f"s{i}"] for i in range(BITS)] for r in sums]) / n
    mean = np.diag(both)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return (both - np.outer(mean, mean)) / np.outer(sd, sd), n


def _salt(fps: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A number below parts for each fingerprint."""
    h = fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % parts.astype(np.uint64)).astype(np.int32)


def _block_links(distance: int):
    """Links between the probes and the entries of one block of a hot value: a spanning forest of them, not all."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("a").to_numpy(), right.column("b").to_numpy()
        heads = tails = np.empty(0, np.int64)
        for i in range(0, len(a) if len(b) else 0, 1 << 10):
            some = a[i : i + (1 << 10)]
            x, y = np.nonzero(np.bitwise_count(some.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= distance)
            heads, tails = forest(np.concatenate([heads, some[x]]), np.concatenate([tails, b[y]]))
        return pa.table({"a": np.minimum(heads, tails), "b": np.maximum(heads, tails)})

    return run


def links(fps: DataFrame, distance: int = 4, groups: int | None = None, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints fp (long) that differ in at most `distance` bits.

    A pair may come more than once. All pairs come but those within a block of
    a hot value, of which a spanning forest comes instead: it connects the same
    fingerprints. Nothing but the 64 x 64 correlations and at most m x 65,536
    histogram cells reaches the driver or a broadcast.
    """
    correlation, n = correlation_of(fps)
    m = groups or group_count(max(n, 1), distance)
    dealt = bit_groups(correlation, m)
    spare = distance - m + 1

    def cells(batches):
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, g in enumerate(dealt):
                at, k = np.unique(values_of(f, g[:CELL_BITS]).astype(np.int64), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(k)], names=["part", "cell", "n"])

    histogram = [np.zeros(1 << min(CELL_BITS, len(g))) for g in dealt]
    found = fps.select("fp").mapInArrow(cells, "part int, cell long, n long").groupBy("part", "cell").agg(F.sum("n").alias("n")).toPandas()
    for part, rows in found.groupby("part"):
        histogram[part][rows["cell"].to_numpy()] = rows["n"].to_numpy()
    levels = max(0, spare) + 2 if spare >= 0 else 2
    near = [ball_counts(h, levels - 2) / 2.0 ** max(0, len(g) - CELL_BITS) for h, g in zip(histogram, dealt)]
    # blocks of entries, and of probes, that the values of a cell are dealt into; 0: the cell isn't hot
    most = [max(hot, 8 * h.mean()) for h in histogram]
    blocks = [np.where(h > k, np.ceil(h / hot), 0).astype(np.int32) for h, k in zip(histogram, most)]
    wide = [np.ceil(x / _WIDE).astype(np.int32) for x in blocks]
    low = np.uint64((1 << CELL_BITS) - 1)

    def placed(part: int, value: np.ndarray, fps: np.ndarray, name: str, entry: bool):
        """Rows for the join: those of a hot cell go to all blocks of the other side."""
        cell = (value & low).astype(np.int64)
        parts, others = blocks[part][cell], wide[part][cell]
        mine, theirs = (parts, others) if entry else (others, parts)
        times = np.maximum(theirs, 1)
        row = np.repeat(np.arange(len(value)), times)
        k = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
        own = np.where(mine > 0, _salt(fps, np.maximum(mine, 1)), -1).astype(np.int32)[row]
        salt, slice_ = (own, k) if entry else (k, own)
        cold = (parts == 0)[row]
        salt, slice_ = np.where(cold, -1, salt).astype(np.int32), np.where(cold, -1, slice_).astype(np.int32)
        return pa.record_batch([pa.array(np.full(len(row), part, np.int32)), pa.array(value.view(np.int64)[row]), pa.array(salt), pa.array(slice_), pa.array(fps[row])], names=["part", "value", "salt", "slice", name])

    def probes(batches):
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(whole), 1 << 14):
                f = whole[lo : lo + (1 << 14)]
                v = [values_of(f.view(np.uint64), g) for g in dealt]
                costs = np.zeros((m, levels, len(f)))
                for i, g in enumerate(dealt):
                    cell = (v[i] & low).astype(np.int64)
                    for t in range(levels - 1):
                        costs[i, t + 1] = near[i][t][cell] + PROBE * sum(comb(len(g), k) for k in range(t + 1))
                t = allocate(costs, spare)
                for i, g in enumerate(dealt):
                    for level in range(levels - 1):
                        here = t[i] == level
                        if here.any():
                            flips = masks(len(g), level)
                            value = (v[i][here][:, None] ^ flips[None, :]).ravel()
                            yield placed(i, value, np.repeat(f[here], len(flips)), "a", False)

    def entries(batches):
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for i, g in enumerate(dealt):
                yield placed(i, values_of(f.view(np.uint64), g), f, "b", True)

    keys = ["part", "value", "salt", "slice"]
    schema = "part int, value long, salt int, slice int, {} long"
    asked = fps.select("fp").mapInArrow(trimmed(probes), schema.format("a"))
    held = fps.select("fp").mapInArrow(trimmed(entries), schema.format("b"))
    cold = F.col("salt") < 0
    near_ = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    out = asked.where(cold).join(held.where(cold), ["part", "value"]).where(near_).select("a", "b")
    if not any(x.any() for x in blocks):
        return out
    dense = asked.where(~cold).groupBy(*keys).cogroup(held.where(~cold).groupBy(*keys)).applyInArrow(_block_links(distance), "a long, b long")
    return out.unionByName(dense.where("a < b"))


def _with_often(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows joined with named, which has each key once and the number of rows that have it (column rows): frequent keys' rows stay where they are."""
    n = named.agg(F.sum("rows")).first()[0] or 0
    often = F.col("rows") > max(OFTEN, n // 10_000)
    few = F.broadcast(named.where(often).drop("rows"))
    rest = rows.join(few.select(key), key, "left_anti").join(named.where(~often).drop("rows"), key)
    return rest.unionByName(rows.join(few, key).select(*rest.columns))


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """Near-duplicate groups: (id_col, fingerprint, component_id), one row for each row of docs.

    Null texts have no words; texts without words have fingerprint zero and are
    linked like any other. Repeated rows are rows of one fingerprint. Null ids
    count for nothing in component_id, which is null if a component has no
    other. Other columns of docs are ignored. An empty table gives no rows.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = stored(with_fingerprint(base, shingle=shingle).select("id", "fp"))
    known = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    tree = components(links(known, distance))
    named = known.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    met = _with_often(rows, named.join(first, "root").select("fp", "rows", "component_id"), "fp")
    return met.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = SHINGLE, least: tuple[int, int] | None = None) -> DataFrame:
    """docs without the near-duplicates of another row: one row of each group stays.

    Groups are those of `distance`, or, with `least` (a fraction), of texts
    whose sets of word shingles have a Jaccard similarity of that or more:
    longer fingerprints propose the pairs and the sets themselves decide (see
    `similar`). The row that stays has the group's least id (nulls last) and,
    among those, its least key and text by hash; one of them stays if there are
    several. Rows without words are one group. All columns stay, whatever their
    names. An empty table gives no rows.
    """
    placed, of = by_place(docs)
    base = placed.select(F.col(of[id_col]).alias("id"), F.xxhash64(of[text]).alias("h"), F.col(of[text]).alias("text"))
    if least is None:
        rows = stored(with_fingerprint(base, name="key", shingle=shingle).select("id", "h", "key"))
        known = stored(rows.groupBy("key").agg(F.count("*").alias("rows")))
        tree = components(links(known.select(F.col("key").alias("fp")), distance))
        drop_stored(known)
    else:
        from lexiweave.llm import similar

        rows, tree = similar.groups(base, shingle, least)
    # nulls sort last among the ids
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "h")
    named = rows.groupBy("key").agg(F.min(order).alias("f")).join(tree.withColumnRenamed("node", "key"), "key", "left")
    leads = stored(named.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("f").alias("f")).select("f.id", "f.h"))
    # a text has one group, so a row that is some lead's (id, h) is that lead or its copy
    each = rows.groupBy("id", "h").agg(F.count("*").alias("rows"))
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["h"] == y["h"])
    lost = stored(each.join(leads, same(each, leads), "left_anti").select("id", "h"))
    again = stored(each.where("rows > 1").join(leads, same(each, leads), "left_semi").select("id", "h"))
    marked = placed.withColumn("h", F.xxhash64(of[text])).withColumn("id", F.col(of[id_col]))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_LOST else df

    kept = marked.join(small(lost), same(marked, lost), "left_anti")
    if again.limit(1).count():
        copies = small(again)
        kept = kept.join(copies, same(kept, again), "left_anti").unionByName(kept.join(copies, same(kept, again), "left_semi").dropDuplicates(["id", "h"]))
    drop_stored(leads, rows)
    return kept.select(*of.values()).toDF(*docs.columns)
