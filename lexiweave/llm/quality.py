"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators, on which a linear SVM is fitted.

Indicators: the text's byte 3-grams in lower case, hashed into DIMENSIONS
cells, and its shape (words equal to their predecessor, distinct words and
length, in steps). The ratios count every labelled training row. The hinge-loss
model is fitted by dual coordinate descent in one task on at most SAMPLE of
them, those least by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.llm._spark import bounded_batches
from lexiweave.llm._text import LOWER, bytes_of, coded, pieces_of, split_words

DIMENSIONS = 1 << 18
#: Cells for the shape, after those of the n-grams.
SHAPE = 512
#: Most labelled rows that the linear model is fitted on.
SAMPLE = 16_384
#: Most labelled rows that are broadcast to find their texts; more are joined by shuffle.
BROADCAST_LABELS = 2_000_000
#: The score at the model's boundary.
BOUNDARY = 0.7
_SHAPE_WEIGHT = 0.35


def shape_of(codes: np.ndarray) -> list[int]:
    """Cells of a text's shape, from the codes of its words."""
    n = len(codes)
    if not n:
        return [DIMENSIONS]
    same = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0
    distinct = len(np.unique(codes)) / n
    size = min(15, int(np.log2(n)))
    at = int(np.ceil(10 * same)) + 1
    return [DIMENSIONS + at, DIMENSIONS + 16 + size, DIMENSIONS + 32 + size * 12 + int(10 * distinct), DIMENSIONS + 256 + size * 12 + at]


def features(text: pa.Array):
    """Yields the distinct cells of each text: of its n-grams, then of its shape."""
    data, ends = bytes_of(text)
    b = np.frombuffer(data.translate(LOWER), np.uint8)
    words, at = split_words(text, LOWER)
    codes, _ = coded(words)
    seen = np.zeros(DIMENSIONS, np.int32)
    ends = ends.astype(np.int64).tolist()
    at = at.tolist()
    for k in range(len(text)):
        row = b[ends[k] : ends[k + 1]].astype(np.uint64)
        if len(row) >= 3:
            cells = ((((row[:-2] << np.uint64(16)) | (row[1:-1] << np.uint64(8)) | row[2:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
            order = np.arange(len(cells), dtype=np.int32)
            seen[cells] = order
            cells = cells[seen[cells] == order]
        else:
            cells = np.empty(0, np.int64)
        yield cells, np.array(shape_of(codes[at[k] : at[k + 1]]), np.int64)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2


def log_ratios(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Log-count ratio of each cell over all rows (text, label), and the rows of label 1 and 0. DIMENSIONS + SHAPE sums reach the driver."""
    cells = DIMENSIONS + SHAPE

    def count(batches):
        total, docs = np.zeros((2, cells), np.int64), [0, 0]
        for batch in pieces_of(batches):
            label = batch.column(1).to_pylist()
            for y, (a, b) in zip(label, features(batch.column(0))):
                total[y][a] += 1
                total[y][b] += 1
                docs[y] += 1
        at = np.flatnonzero(total.any(axis=0))
        at_all = np.append(at, cells)
        both = np.concatenate([total[:, at], np.array(docs)[:, None]], axis=1)
        for i in range(0, len(at_all), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.record_batch([pa.array(at_all[s]), pa.array(both[0, s]), pa.array(both[1, s])], names=["cell", "zero", "one"])

    sums = rows.select("text", "label").mapInArrow(count, "cell long, zero long, one long").groupBy("cell").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toPandas()
    q, p = np.ones(cells + 1), np.ones(cells + 1)
    q[sums["cell"]] += sums["zero"]
    p[sums["cell"]] += sums["one"]
    zeroes, ones = int(q[cells]) - 1, int(p[cells]) - 1
    ratio = np.zeros(cells)
    for part in (slice(0, DIMENSIONS), slice(DIMENSIONS, cells)):
        ratio[part] = np.log(p[part] / p[part].sum()) - np.log(q[part] / q[part].sum())
    return ratio, ones, zeroes


def descend(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, bound: float = 1.0, passes: int = 300, tolerance: float = 1e-3) -> np.ndarray:
    """Linear hinge-loss model by dual coordinate descent; rows are (cells, values); the last weight is the bias.

    Ends when no row's slope leads further than the tolerance. A row that is at
    a bound and leads well beyond it is left out until the others are done.
    """
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1 for _, v in rows])
    random, live, far = np.random.default_rng(0), np.arange(len(rows)), np.inf
    for _ in range(passes):
        worst, stay = 0.0, np.ones(len(live), bool)
        order = random.permutation(len(live))
        for k in order:
            i = live[k]
            at, v = rows[i]
            slope = signs[i] * (w[at] @ v + w[-1]) - 1
            leads = min(slope, 0.0) if alpha[i] == 0 else max(slope, 0.0) if alpha[i] == bound else slope
            if not leads:
                stay[k] = abs(slope) <= far
                continue
            worst = max(worst, abs(leads))
            new = min(max(alpha[i] - slope / norm[i], 0.0), bound)
            step = (new - alpha[i]) * signs[i]
            w[at] += step * v
            w[-1] += step
            alpha[i] = new
        if worst >= tolerance:
            live, far = live[stay], worst
        elif len(live) == len(rows):
            break
        else:
            live, far = np.arange(len(rows)), np.inf
    return w


def _values(ratio: np.ndarray, grams: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([grams, shape]), np.concatenate([ratio[grams] / np.sqrt(max(1, len(grams))), ratio[shape] * _SHAPE_WEIGHT])


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights by cell (ratios included) and the bias, from training rows (id, text, label 0 or 1).

    Without rows of both labels the weights are zero and the bias tells the
    label that there is, or nothing. The one task that fits gets the sampled
    rows' cells, DIMENSIONS + 4 of them at most for each, and no text.
    """
    ratio, ones, zeroes = log_ratios(rows)
    if not ones or not zeroes:
        return np.zeros_like(ratio), float(bool(ones)) - float(bool(zeroes))
    share = sample / (ones + zeroes)
    chosen = rows.select(F.xxhash64("id", "text").alias("h"), "text", "label")
    if share < 1:  # cut to about the sample before its exact order
        chosen = chosen.where((F.pmod("h", F.lit(1 << 20)) < int(share * 1.2 * (1 << 20)) + 1))

    def cells(batches):
        for batch in pieces_of(batches, 1):
            grams, shape = zip(*features(batch.column(1)))
            lists = [pa.array([x.astype(np.int32) for x in side], pa.list_(pa.int32())) for side in (grams, shape)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=["h", "label", "grams", "shape"])

    told = chosen.mapInArrow(cells, "h long, label int, grams array<int>, shape array<int>").orderBy("h").limit(sample)
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        ratio, data = shared.value, []
        for batch in table.to_batches():
            sides = [(x.flatten().to_numpy(), x.offsets.to_numpy() - x.offsets[0].as_py()) for x in (batch.column("grams"), batch.column("shape"))]
            data += [_values(ratio, *[flat[ends[i] : ends[i + 1]] for flat, ends in sides]) for i in range(batch.num_rows)]
        w = descend(data, np.where(table.column("label").to_numpy() > 0, 1.0, -1.0), len(ratio))
        return pa.table({"w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    w = np.array(told.groupBy(F.lit(0).alias("all")).applyInArrow(solve, "w array<double>").first()["w"])
    return w[:-1] * ratio, float(w[-1])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """docs with columns held_out, score and predicted added (or replaced, if docs has such columns).

    Learns from the rows of docs with a label whose crc32 of the id, as text,
    modulo 4 isn't 2; nothing but the text is an input. Score is 0 to 1,
    BOUNDARY at the model's boundary; predicted is 1 from there on. Null texts
    count as empty, and empty texts have a shape and so a score. Labels that are
    null or neither 0 nor 1 count for nothing; several labels of an id count as
    the largest. Null ids aren't held out and have no label. Rows with repeated
    ids are scored each on its own. Other columns stay; an empty table gives no
    rows, and a table without labels the same score for all.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(marks, "id")
    coefficient, bias = fit(rows, sample)
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    at = own.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((coefficient, bias))
    schema = T.StructType([*[docs.schema[c] for c in own], T.StructField("score", T.DoubleType())])

    def run(batches):
        w, b = shared.value
        for batch in pieces_of(batches, at):
            margin = np.array([w[g].sum() / np.sqrt(max(1, len(g))) + w[s].sum() * _SHAPE_WEIGHT + b for g, s in features(batch.column(at))])
            low = np.log(BOUNDARY / (1 - BOUNDARY))
            out = 1 / (1 + np.exp(-np.clip(3 * margin + low, -30, 30)))
            # the boundary itself rounds to either side of BOUNDARY
            out = np.where(margin >= 0, np.maximum(out, BOUNDARY), np.minimum(out, np.nextafter(BOUNDARY, 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*own, "score"])

    out = docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, schema)
    return out.select(*[F.col(f"`{c}`") for c in own], F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= BOUNDARY).cast("int").alias("predicted"))
