"""Hard negatives against brute force, on odd rows too."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mtree import clusters, whole

from corpusmill.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, pos string, x int"


def brute(rows, every, k=5, m=3):
    held = [(r[0], r[2], v) for r, v in whole([r for r in rows if r[2] is not None], 256)]
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, (q, label, a) in enumerate(held):
        if q is not None and q % every == 0:
            scored = sorted((-score(a, c[2]), c[0] is None, c[0] or 0, j, c[1] == label) for j, c in enumerate(held) if j != i)
            for p in [s for s in scored if s[4]][:k]:
                fit = [s for s in scored if not s[4] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:m]
                out += [(q, None if p[1] else p[2], rank, None if s[1] else s[2], -p[0], -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


def run(spark, rows, every=5, **more):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, H.hard_negatives(table, F.col("vec_id") % every == 0, F.col("label"), **more).collect()), key=repr)


@pytest.mark.parametrize("block,size", [(1024, 8192), (7, 50)])
def test_clustered_points(spark, monkeypatch, block, size):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "SLICE", size)
    rng = np.random.default_rng(9)
    rows = [(i, list(v), int(rng.integers(4)), "a", 2) for i, v in enumerate(clusters(rng, 900, spread=0.3))]
    expected = brute(rows, 30)
    assert len(expected) > 100 and run(spark, rows, every=30, cells=9) == expected


def test_rows_are_sent_only_where_they_may_serve(spark):
    rng = np.random.default_rng(2)
    rows = [(i, list(v), i % 3, "a", 2) for i, v in enumerate(clusters(rng, 1500, spread=0.01))]
    table, space = H.points(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 256, label=F.col("label"), anchor=F.col("vec_id") % 10 == 0)
    at = H.pivots(table, space, 12)
    anchors = H._to_pivots(table.where("anchor").select("pos", "label", "x"), at, space)
    own = F.array_position("to_pivot", F.array_min("to_pivot")).cast("int")
    anchors = anchors.withColumn("grp", own)
    near = H._ranges(anchors, ["grp"], F.lit(0.0), F.lit(300.0), space.slack)
    sent, _ = H._served(H.nearest(table, at, space).drop("anchor"), near, anchors, ["grp"])
    assert sent.count() < 0.5 * 1500 * anchors.select("grp").distinct().count()


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(5)], rng.randrange(3), "a", 2) for i in range(200)]
    rows += [(5, [1.0] * 5, 1, "a", 2), (5, [1.0] * 5, 1, "a", 2), (7, [1.0] * 5, None, None, None), (None, [1.0] * 5, 1, "a", 2), (None, [0.7] * 5, 2, "a", 2)]
    rows += [(500, None, 1, "a", 2), (505, [1.0, None, 1.0, 1.0, 1.0], 1, "a", 2), (510, [float("nan")] * 5, 1, "a", 2), (515, [float("-inf")] * 5, 1, "a", 2)]
    rows += [(520, [], 1, "a", 2), (525, [0.25], 1, "a", 2), (530, [0.0] * 5, 1, "a", 2), (535, [2.0] * 5, 9, "a", 2)]
    assert run(spark, rows) == brute(rows, 5)


def test_ties_and_one_label(spark):
    rows = [(i, [0.5, 0.25], 1, "a", 2) for i in range(300, 0, -1)] + [(i, [0.4, 0.2], 2, "a", 2) for i in range(400, 300, -1)]
    assert run(spark, rows, every=100) == brute(rows, 100)
    assert run(spark, [(i, [1.0], 1, "a", 2) for i in range(20)]) == []


def test_great_components(spark):
    rows = [(i, [10.0 ** (i // 2), 3.0], i % 2, "a", 2) for i in range(30)]
    assert run(spark, rows, every=2) == brute(rows, 2)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1, "a", 2)], [(5, [1.0], 1, "a", 2)], [(5, [], 1, "a", 2), (10, [], 1, "a", 2), (11, [], 2, "a", 2)], [(5, None, 1, "a", 2)]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows, 5)
