import numpy as np
import pytest

from lectern.llm import vector_dedup
from lectern.llm.components import components


def brute(rows, threshold=0.98):
    ok = [i for i, (k, v, lab) in enumerate(rows) if k is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    near[a].add(b)
                    near[b].add(a)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            todo, got = [i], {i}
            while todo:
                for j in near[todo.pop()] - got:
                    got.add(j)
                    todo.append(j)
            seen |= dict.fromkeys(got, min((rows[j][0] for j in got if rows[j][0] is not None), default=None))
        k = rows[i][0]
        out.append((k, len(near[i]), seen[i], True if k is None else k == seen[i]))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.05).tolist(), int(c % 3)))
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, (np.array(rows[0][1]) * 4).tolist(), rows[0][2]), (n + 2, rows[0][1], None), (n + 3, None, 1), (n + 4, [], 1)]
    rows += [(n + 5, [0.0] * 16, 1), (n + 6, [1.0, None] * 8, 1), (n + 7, [float("nan")] * 16, 1), (n + 8, [float("inf")] * 16, 1), (n + 9, [1.0, 2.0], 1), (n + 10, [1.0, 2.01], 1)]
    rows += [(n + 9, [1.0, 2.0], 1), (None, rows[1][1], rows[1][2])]
    old = vector_dedup.CELL, vector_dedup.MIN_BLOCK
    vector_dedup.CELL, vector_dedup.MIN_BLOCK = 4, 3
    try:
        df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, cls string")
        got = sorted((tuple(r) for r in vector_dedup.near_duplicates(df).collect()), key=str)
    finally:
        vector_dedup.CELL, vector_dedup.MIN_BLOCK = old
    assert got == brute(rows)


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(1500, 64))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    move = rng.normal(size=unit.shape)
    copies = unit + move / np.linalg.norm(move, axis=1, keepdims=True) * 0.19
    x = np.concatenate([unit, copies]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(df).collect()}
    assert sum(got[i] != got[i + 1500] for i in range(1500)) < 5  # a pair counts at both ends
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    found = sum(got.values()) / want.sum()
    assert all(got[i] <= want[i] for i in got) and want.sum() > 2000
    assert found >= 0.99


def test_empty(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_paths_stars_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    edges += [(5000, i) for i in range(1000, 2500)] + [(i, 7000) for i in range(6000, 6200)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    far = {**dict.fromkeys(range(1001, 2500), 1000), 5000: 1000, **dict.fromkeys(range(6001, 6200), 6000), 7000: 6000}
    assert roots == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}, 301: 300, **far}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))]
    root = list(range(400))
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame([(f"{a:04}", f"{b:04}") for a, b in edges], "u string, v string").repartition(7)).collect()}
    assert got == {f"{i:04}": f"{root[i]:04}" for i in range(400) if root[i] != i}
