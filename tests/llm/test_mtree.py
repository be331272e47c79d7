"""The M-tree: its pages, and searches against brute force, on odd rows too."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import metric, mtree

SCHEMA = "vec_id long, embedding array<float>, label int, pos string, x int"


def whole(rows, factor=1024):
    """(row, its components), as Spark holds floats."""
    out = []
    for row in rows:
        v = row[1]
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            out.append((row, [max(-(2**63), min(2**63 - 1, math.floor(factor * float(np.float32(c))))) for c in v]))
    return out


def brute(rows, every, k=10):
    held, out = whole(rows), []
    for i, (q, a) in enumerate(held):
        if q[0] is not None and q[0] % every == 0:
            found = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), c[0] is None, c[0] or 0) for j, (c, b) in enumerate(held) if j != i]
            out += [(q[0], rank, None if n else v, -s) for rank, (s, n, v) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, rows, every=5, **more):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r)[:4] for r in mtree.top_k(table, F.col("vec_id") % every == 0, **more).collect()), key=repr)


def clusters(rng, n, dim=8, centres=12, spread=0.03):
    at = rng.normal(size=(centres, dim))
    return [tuple(map(float, at[rng.integers(centres)] + spread * rng.normal(size=dim))) for _ in range(n)]


def test_clustered_points_in_many_subtrees(spark):
    rng = np.random.default_rng(3)
    rows = [(i, list(v), 1, "a", 2) for i, v in enumerate(clusters(rng, 3000))]
    table = spark.createDataFrame(rows, SCHEMA)
    found = mtree.top_k(table, F.col("vec_id") % 50 == 0, tree_rows=400, roots=5).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == brute(rows, 50)
    # the bounds spare more than half of all products
    assert sum({r.query_id: r.computed for r in found}.values()) < 0.5 * 60 * 3000


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], 1, "a", 2) for i in range(300)]
    rows += [(5, [1.0] * 6, 1, "a", 2), (5, [1.0] * 6, 1, "a", 2), (7, [1.0] * 6, None, None, None), (None, [1.0] * 6, 1, "a", 2), (None, [0.5] * 6, 1, "a", 2)]
    rows += [(500, None, 1, "a", 2), (505, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "a", 2), (510, [float("nan")] * 6, 1, "a", 2), (515, [float("inf")] * 6, 1, "a", 2)]
    rows += [(520, [], 1, "a", 2), (525, [0.25], 1, "a", 2), (530, [0.0] * 6, 1, "a", 2), (535, [-0.0] * 6, 1, "a", 2)]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, rows, tree_rows=40, roots=7) == brute(rows, 5)


def test_ties_and_copies(spark):
    rows = [(i, [0.5, 0.25], 1, "a", 2) for i in range(700, 0, -1)] + [(i, [float(i % 3), 1.0], 1, "a", 2) for i in range(701, 1000)]
    assert run(spark, rows, every=100, tree_rows=300) == brute(rows, 100)


def test_great_components(spark):
    rows = [(i, [(-1.0) ** i * 10.0**i, 3.0], 1, "a", 2) for i in range(38)]
    assert run(spark, rows, every=2) == brute(rows, 2)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1, "a", 2)], [(5, None, 1, "a", 2)], [(5, [1.0], 1, "a", 2)], [(5, [1.0], 1, "a", 2), (1, [2.0], 1, "a", 2)], [(5, [], 1, "a", 2), (10, [], 1, "a", 2)]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows, 5)


def test_pages_cover_all_points():
    rng = np.random.default_rng(5)
    x = np.rint(1000 * np.array(clusters(rng, 2000))).astype(np.int64)
    x[500:900] = x[0]
    most = float((x**2).sum(1).max())
    sphere = metric.on_sphere(x, most)
    pages = mtree.pages_of(x, sphere, sphere[0], leaf=50, fanout=6)
    seen = []

    def below(number, point):
        leaf, entries, child, to_parent, radius = pages[number]
        assert len(entries) <= (50 if leaf else 6)
        assert np.allclose(to_parent, metric.distances(sphere[entries], point[None])[:, 0])
        if leaf:
            seen.extend(entries)
            return list(entries)
        out = []
        for e, c, r in zip(entries, child, radius):
            rows = below(c, sphere[e])
            assert metric.distances(sphere[rows], sphere[[e]]).max() <= r + 1e-3
            out += rows
        return out

    below(0, sphere[0])
    assert sorted(seen) == list(range(2000))
