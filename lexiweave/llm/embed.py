"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label are one point. Points of a label that are too many for
one task are dealt into cells around centres; a pair of cells is compared only
if its centres are no farther apart than the two covering radii and the
threshold allow, and a cell of too many points is salted into blocks. A task
builds a cover tree for each of its blocks - nested levels with halving radii -
and descends both at once, leaving out node pairs by the same bound. It returns
each point's number of links and a spanning star of the links, never the pairs.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.llm._spark import components, drop_stored, forest, stored

#: Most points of a block.
BLOCK = 4096
#: Centres of a label that is dealt into cells, all labels' centres, and the sample (by hash) that each label's are chosen from.
CENTRES, ALL_CENTRES, SAMPLE = 64, 1 << 15, 2048
_LEVELS = 14
_SLACK = 1e-7


class CoverTree:
    """Unit vectors in nested levels; a node covers its members within `radius` (their largest chord) of its centre."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre, self.radius, self.children, self.members = [], [], [], []
        if len(points):
            self._grow(np.arange(len(points)), 0, 1.0)

    def _grow(self, members: np.ndarray, centre_at: int, reach: float) -> int:
        """Adds a node whose centre is members[centre_at]."""
        node = len(self.centre)
        centre = members[centre_at]
        far = np.sqrt(np.maximum(0, 2 - 2 * (self.points[members] @ self.points[centre])))
        self.centre.append(centre)
        self.radius.append(float(far.max()) + _SLACK if len(members) > 1 else 0.0)
        self.children.append(np.empty(0, np.int64))
        self.members.append(members)
        if len(members) > 1 and reach > 2.0**-_LEVELS:
            kids, left, first = [], members, centre_at
            while len(left):
                near = 2 - 2 * (self.points[left] @ self.points[left[first]]) <= reach * reach
                near[first] = True
                kids.append((left[near], int(near[:first].sum())))
                left, first = left[~near], 0
            if len(kids) == 1:  # this level parts nothing
                self.children[node] = np.array([self._grow(members, centre_at, reach / 2)])
            elif all(len(m) == 1 for m, _ in kids):
                pass  # all apart: the members themselves are the last level
            else:
                self.children[node] = np.array([self._grow(m, c, reach / 2) for m, c in kids])
        return node


def dual(a: CoverTree, b: CoverTree, least: float):
    """Yields (i, j) arrays of the points of a and of b with cosine `least` or more."""
    apart = sqrt(max(0.0, 2 - 2 * least)) + _SLACK
    stack = [(0, 0)] if len(a.points) and len(b.points) else []
    while stack:
        x, y = stack.pop()
        kx, ky = a.children[x], b.children[y]
        if not len(kx) and not len(ky):
            mx, my = a.members[x], b.members[y]
            i, j = np.nonzero(a.points[mx] @ b.points[my].T >= least)
            if len(i):
                yield mx[i], my[j]
            continue
        kx, ky = (kx if len(kx) else np.array([x])), (ky if len(ky) else np.array([y]))
        ca, cb = np.array([a.centre[k] for k in kx]), np.array([b.centre[k] for k in ky])
        ra, rb = np.array([a.radius[k] for k in kx]), np.array([b.radius[k] for k in ky])
        far = np.sqrt(np.maximum(0, 2 - 2 * (a.points[ca] @ b.points[cb].T)))
        i, j = np.nonzero(far <= apart + ra[:, None] + rb[None, :])
        stack += zip(kx[i].tolist(), ky[j].tolist())


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _task(least: float):
    def run(table: pa.Table) -> pa.Table:
        rep, size = (table.column(c).to_numpy() for c in ("rep", "size"))
        second, x = table.column("second").to_numpy(zero_copy_only=False), _matrix(table.column("vector"))
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        count, heads, tails = np.zeros(len(rep), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        own = not len(right)
        a = CoverTree(x[left])
        for i, j in dual(a, a if own else CoverTree(x[right]), least):
            if own:
                i, j = i[i < j], j[i < j]
            else:
                j = right[j]
            i = left[i]
            np.add.at(count, i, size[j])
            np.add.at(count, j, size[i])
            heads, tails = np.concatenate([heads, i]), np.concatenate([tails, j])
            if len(heads) > 1 << 20:
                heads, tails = forest(heads, tails)
        root = np.arange(len(rep))
        if len(heads):
            nodes, roots = forest(heads, tails)
            root[nodes] = roots
        on = np.flatnonzero((count > 0) | (root != np.arange(len(rep))))
        return pa.table({"rep": rep[on], "links": count[on], "root": rep[root[on]]})

    return run


def centres_of(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first centres of unit vectors, at most so many."""
    chosen = [0]
    far = 2 - 2 * (sample @ sample[0])
    while len(chosen) < min(most, len(sample)) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * (sample @ sample[chosen[-1]]))
    return sample[chosen]


def packed(cells, block: int) -> np.ndarray:
    """The pack of each of a label's cells (its points): neighbours share one while they have `block` points at most."""
    pack, room, out = -1, block + 1, np.zeros(len(cells), np.int64)
    for i, n in enumerate(cells):
        if room + n > block:
            pack, room = pack + 1, 0
        room += n
        out[i] = pack
    return out


def _dealt(points: DataFrame, least: float, block: int, centres: int) -> DataFrame:
    """points with `task` and `second` (the side of a comparison of two blocks), once for each task that needs them.

    The driver sees the labels of more than `block` points, their centres and
    the cells around them: ALL_CENTRES rows at most, and the pairs of one
    label's cells. Blocks, and pairs of them, come from these by joins.
    """
    spark = points.sparkSession
    kind = T.StructType([points.schema["label"], T.StructField("dim", T.IntegerType())])
    hot = points.groupBy("label", "dim").count().where(F.col("count") > block).orderBy(F.desc("count"), "label", "dim").collect()
    none = F.lit(None).cast("string")
    if not hot:
        return points.select("label", "dim", none.alias("task"), F.lit(False).alias("second"), "rep", "size", "vector")
    most = max(2, min(centres, ALL_CENTRES // len(hot)))
    numbers = F.broadcast(spark.createDataFrame([(r["label"], r["dim"], r["count"], k) for k, r in enumerate(hot)], T.StructType([*kind.fields, T.StructField("n", T.LongType()), T.StructField("number", T.IntegerType())])))
    small = points.join(numbers, ["label", "dim"], "left_anti").select("label", "dim", none.alias("task"), F.lit(False).alias("second"), "rep", "size", "vector")
    mine = points.join(numbers, ["label", "dim"])
    drawn = mine.where(F.pmod(F.xxhash64("vector"), F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE)).cast("long")) == 0).select("number", "vector")

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        c = centres_of(_matrix(table.column("vector")), most)
        return pa.table({"number": pa.array([key[0].as_py()] * len(c), pa.int32()), "centre": pa.array(list(c), pa.list_(pa.float64()))})

    found: dict[int, np.ndarray] = {}
    for number, rows in drawn.groupBy("number").applyInArrow(choose, "number int, centre array<double>").toPandas().groupby("number"):
        found[int(number)] = np.stack(rows["centre"].to_numpy())
    for number, r in enumerate(hot):  # a sample may be empty
        found.setdefault(number, np.eye(1, r["dim"]))
    shared = spark.sparkContext.broadcast(found)

    def nearest(batches):
        for batch in batches:
            number = batch.column(0).to_numpy()
            cell, far = np.zeros(len(number), np.int32), np.zeros(len(number))
            for k in np.unique(number):
                at = np.flatnonzero(number == k)
                cosine = _matrix(batch.column(3).take(pa.array(at))) @ shared.value[int(k)].T
                cell[at] = cosine.argmax(axis=1)
                far[at] = np.sqrt(np.maximum(0, 2 - 2 * cosine.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["number", "rep", "size", "vector", "label", "dim", "cell", "far"])

    asked = mine.select("number", "rep", "size", "vector", "label", "dim")
    placed = stored(asked.mapInArrow(nearest, T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])))
    cells = placed.groupBy("number", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).orderBy("number", "cell").toPandas()
    # a pack is some small cells, or one that is salted into blocks; two packs are compared if any of their cells meet
    packs, meetings = [], []  # (number, cell, pack, blocks), (number, pack, other, side, blocks of the other)
    apart = sqrt(max(0.0, 2 - 2 * least)) + _SLACK
    for number, rows in cells.groupby("number"):
        c, n = found[int(number)][rows["cell"].to_numpy()], rows["n"].to_numpy()
        radius = rows["radius"].to_numpy() + _SLACK
        pack = packed(n, block)
        of = np.eye(pack.max() + 1, dtype=bool)[pack]
        meets = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) <= apart + radius[:, None] + radius[None, :]
        blocks = -(-(of * n[:, None]).sum(axis=0) // block)
        packs += [(int(number), int(x), int(p), int(blocks[p])) for x, p in zip(rows["cell"], pack)]
        for x, y in zip(*np.nonzero(of.T @ meets @ of)):
            if x != y:
                meetings.append((int(number), int(x), int(y), bool(x > y), int(blocks[y])))
    block_of = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    packs = F.broadcast(spark.createDataFrame(packs, "number int, cell int, pack int, blocks int"))
    dealt = placed.join(packs, ["number", "cell"]).withColumn("mine", block_of).drop("cell", "far")
    # within a pack: a block with itself, and with each other one, the lesser of the two being the first side
    own = dealt.withColumn("other", F.col("pack")).withColumn("theirs", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("second", F.col("mine") > F.col("theirs"))
    out = own
    if meetings:
        others = F.broadcast(spark.createDataFrame(meetings, "number int, pack int, other int, second boolean, of int"))
        across = dealt.join(others, ["number", "pack"]).withColumn("theirs", F.explode(F.expr("sequence(0, of - 1)"))).drop("of")
        out = own.unionByName(across)
    sides = [F.struct("pack", "mine"), F.struct(F.col("other").alias("pack"), F.col("theirs").alias("mine"))]
    names = [F.when(F.col("second"), sides[1 - k]).otherwise(sides[k]) for k in (0, 1)]
    task = F.concat_ws(" ", "number", *[x[c].cast("string") for x in names for c in ("pack", "mine")])
    return small.unionByName(out.select("label", "dim", task.alias("task"), "second", "rep", "size", "vector"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of vectors.

    Vectors link if their labels, of any type that can be compared, are equal and not null, they have as many
    components and their cosine in double precision is `least` or more. Null
    vectors, vectors of zeroes (or none) and those with a null or non-finite
    component link with nothing. n_links counts the other rows that a row links
    with, component_id is the least id reachable, nulls left out; kept tells
    whether that is the row's own. Repeated rows are separate rows and link. A
    null id is kept only if nothing in its component has an id. Other columns
    are ignored; an empty table gives no rows.
    """
    numbers = F.transform(vector, lambda x: x.cast("double"))
    good = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(f"`{label}`").alias("label"), F.when(good, numbers).alias("vector"))
    whole = rows.where("vector is not null")
    points = stored(whole.groupBy("label", "vector").agg(F.count("*").alias("size"), F.min("id").alias("least")).withColumn("dim", F.size("vector")).withColumn("rep", F.monotonically_increasing_id()))
    tasks = _dealt(points.select("label", "dim", "rep", "size", "vector"), least, block, centres)
    found = stored(tasks.groupBy("label", "dim", "task").applyInArrow(_task(least), "rep long, links long, root long"))
    tree = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = points.select("label", "vector", "rep", "size", "least").join(linked, "rep", "left").join(tree.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    known = named.join(names, "root").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), "component")
    out = rows.join(known, ["label", "vector"], "left")
    component = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
