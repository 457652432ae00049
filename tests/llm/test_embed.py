import datetime
import math

import numpy as np
import pytest
from lexiweave.llm import embed
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int"


def data(n=160, dim=8, seed=0):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = g.normal(size=dim)
        rows.append((i, x, int(g.integers(0, 2))))
        for _ in range(int(g.integers(0, 3))):
            rows.append((1000 + len(rows), x * g.uniform(0.5, 3) + g.normal(size=dim) * g.choice([0, 0.02, 0.08, 0.2]), rows[-1][2]))
    rows = [(i, [float(np.float32(v)) for v in x], k) for i, x, k in rows]
    rows += [(3000 + k, rows[0][1], rows[0][2]) for k in range(30)]
    return rows + [
        (5000, None, 0), (5001, [], 0), (5002, [0.0] * dim, 0), (5003, [None] + [1.0] * (dim - 1), 0), (5004, [math.nan] + [1.0] * (dim - 1), 0), (5005, [math.inf] + [1.0] * (dim - 1), 0),
        (5006, rows[0][1], None), (5007, rows[0][1][:3], 0), (5008, rows[0][1][:3], 0), (5009, [1e-30] * dim, 0), (5010, [1e30] * dim, 0), (5011, [1e-30] * dim, 0),
    ]


def brute(rows):
    unit = []
    for _, x, label in rows:
        good = label is not None and x and None not in x and all(map(math.isfinite, x)) and any(x)
        v = np.array(x, float) if good else None
        unit.append((label, v / np.sqrt(v @ v)) if good else None)
    n, root = [0] * len(rows), list(range(len(rows)))
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a and b and a[0] == b[0] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.98:
                n[i] += 1
                n[j] += 1
                p, q = root[i], root[j]
                root = [min(p, q) if r in (p, q) else r for r in root]
    least = {}
    for k, r in enumerate(root):
        ids = [x for x in (least.get(r), rows[k][0]) if x is not None]
        least[r] = min(ids) if ids else None
    return sorted(((rows[k][0], n[k], least[root[k]], rows[k][0] == least[root[k]]) for k in range(len(rows))), key=repr)


@pytest.mark.parametrize("block, centres", [(4096, 64), (40, 8), (16, 32), (7, 3)])
def test_against_brute_force(spark, block, centres):
    rows = data()
    df = spark.createDataFrame(rows, VECTORS).withColumn("rep", F.lit(1)).withColumn("size", F.lit("x")).repartition(3)
    out = embed.near_duplicates(df, block=block, centres=centres)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (None, [0.0, 1.0], 0), (None, [5.0, 5.0], 0), (None, [5.0, 5.0], 0)]
    got = sorted((tuple(r) for r in embed.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("block", [4096, 16])
def test_labels_of_any_type(spark, block):
    rows = data(60)
    want = brute(rows)
    for kind, cast in (("string", lambda k: f"label {k}"), ("date", lambda k: datetime.date(2020, 1, 1 + k)), ("boolean", bool), ("struct<a:int,b:string>", lambda k: (k, "x"))):
        df = spark.createDataFrame([(i, x, None if k is None else cast(k)) for i, x, k in rows], f"vec_id long, embedding array<float>, label {kind}")
        assert sorted((tuple(r) for r in embed.near_duplicates(df, block=block, centres=8).collect()), key=repr) == want


def test_packs_are_bounded():
    g = np.random.default_rng(0)
    for _ in range(50):
        cells = g.integers(1, 40, 30)
        pack = embed.packed(cells, 25)
        assert (np.diff(pack) >= 0).all() and pack[0] == 0 and set(pack) == set(range(pack[-1] + 1))
        for p in range(pack[-1] + 1):
            assert cells[pack == p].sum() <= 25 or (pack == p).sum() == 1


def test_each_pair_of_blocks_meets_once(spark):
    """Every two points whose cells may hold a link meet in one task, and no task has more than two blocks."""
    g = np.random.default_rng(5)
    x = g.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(0, 4, i, 1, v.tolist()) for i, v in enumerate(x)], "label int, dim int, rep long, size long, vector array<double>")
    tasks = {}
    for r in embed._dealt(df, 0.9, 20, 6).collect():
        tasks.setdefault(r["task"], ([], []))[r["second"]].append(r["rep"])
    met = {}
    for left, right in tasks.values():
        for i in left:
            for j in right or left:
                if i != j:
                    met[frozenset((i, j))] = met.get(frozenset((i, j)), 0) + (1 if right else 0.5)
    assert set(met.values()) == {1}
    assert all(frozenset((i, j)) in met for i in range(300) for j in range(i) if x[i] @ x[j] >= 0.9)


def test_no_vectors(spark):
    assert embed.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    assert embed.near_duplicates(spark.createDataFrame([(1, None, None)], VECTORS)).collect()[0]["kept"]


def test_dual_traversal_finds_all_pairs():
    g = np.random.default_rng(3)
    for spread in (0.05, 0.2, 1.0):
        x = np.repeat(g.normal(size=(30, 5)), 10, axis=0) + spread * g.normal(size=(300, 5))
        x /= np.linalg.norm(x, axis=1)[:, None]
        a, b = embed.CoverTree(x[:140]), embed.CoverTree(x[140:])
        got = {(i, j) for p, q in embed.dual(a, b, 0.98) for i, j in zip(p.tolist(), q.tolist())}
        assert got == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(x[:140] @ x[140:].T >= 0.98)))}
        for node, members in enumerate(a.members):
            far = np.sqrt(np.maximum(0, 2 - 2 * x[members] @ x[a.centre[node]]))
            assert far.max() <= a.radius[node] + 1e-7
