import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import embedding_dedup as E
from evidentia.llm.components import components


def brute(rows, threshold):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(k, i, np.array(v, float) / np.linalg.norm(v), label) for k, (i, v, label) in enumerate(rows) if usable(v, label)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, _, x, la in good:
        for b, _, y, lb in good:
            if a < b and la == lb and len(x) == len(y) and x @ y >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(b)] = root(a)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, links[k], least[root(k)]) for k, (i, _, _) in enumerate(rows))


def vectors(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, rng.choice([0, 0.05, 0.1]), dims)
        else:
            v = rng.normal(0, 1, dims)
        rows.append((i, [float(x) for x in v], int(rng.integers(3))))
    bad = [None, [0.0] * dims, [float("nan")] * dims, [None] + [1.0] * (dims - 1), [float("inf")] + [1.0] * (dims - 1), []]
    again = [(3, [float(x) for x in rng.normal(0, 1, dims)], rows[3][2]), (3, rows[3][1], rows[3][2]), (4, rows[7][1], (rows[4][2] + 1) % 3), (4, rows[4][1], (rows[4][2] + 1) % 3)]
    return [*rows, *again, *((n + k, v, 1) for k, v in enumerate(bad)), (n + 10, rows[0][1], None), (n + 11, [1.0, 2.0], 1), (n + 12, [1.0, 2.1], 1), (n + 13, [3.0], 1), (n + 14, [4.0], 1)]


@pytest.mark.parametrize(("seed", "cell", "block"), [(1, 4, 2048), (2, 16, 5), (3, 1024, 2048)])
def test_every_link_is_found(spark, monkeypatch, seed, cell, block):
    monkeypatch.setattr(E, "PER_CELL", cell)
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors(seed, 150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("rep", "h", "v", "n", "p", "q")})
    got = sorted((r.id, r.n_links, r.component_id) for r in E.near_duplicates(df, 0.93).collect())
    assert got == brute(rows, 0.93)


def test_an_id_with_two_vectors(spark):
    rows = [(5, [1.0, 0.0], 1), (6, [1.0, 0.01], 1), (5, [0.0, 1.0], 2), (7, [0.01, 1.0], 2), (8, [0.02, 1.0], 2)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in got) == [(5, 1, 5), (5, 2, 5), (6, 1, 5), (7, 2, 5), (8, 2, 5)]


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    cells = E.traverse(a, b, 0.9)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums)
    assert len(cells) == len(set(cells)) == sum(x + y <= 0.9 for x in a for y in b)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(200, 4)), E.codebook(rng.normal(size=(300, 4)), 8)
    own, low = E.bounds(x, c)
    for i in range(0, 200, 7):
        d = ((x - x[i]) ** 2).sum(1)
        assert all(d[j] >= low[i, own[j]] - 1e-9 for j in range(200))


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (5, 5), (None, 3), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
