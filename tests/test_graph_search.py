"""Names found by runs of signs, steps from many starts, bounds: against brute force."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import graph as G


def test_names_that_contain_one_another(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abC 北") for _ in range(rng.randrange(1, 7))).strip() or "a"
    entities = [(word(), rng.choice("xy")) for _ in range(400)] + [("Ab", "x"), ("b", "y"), ("Turing Machine", "x")]
    asked = {word() for _ in range(60)} | {"a", "AB", "turing", "the Turing machine of 1936", "zzz", ""}
    low = lambda t: t.lower()
    from corpusmill.functions.text import normalized_name

    rows = spark.createDataFrame(entities, "name string, type string").select(normalized_name(F.col("name")).alias("name"), "type")
    names = {low(r.n) for r in spark.createDataFrame([(a,) for a in asked], "a string").select(normalized_name(F.col("a")).alias("n")).collect()} - {""}
    want = sorted((a, e.name, e.type) for a in names for e in rows.collect() if low(e.name) == a or len(a) >= 2 and a in low(e.name) or len(e.name) >= 2 and low(e.name) in a)
    found = G.matched(rows, spark.createDataFrame([(a,) for a in asked], "asked string"))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_steps_from_many_starts(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(1, 1), (100, 101)]
    starts = [0, 1, 5, 5, 100, 999, None]
    found = G.reached_from(spark.createDataFrame(edges, "source int, target int"), spark.createDataFrame([(s,) for s in starts], "start int"), 3)
    want = set()
    for s in {0, 1, 5, 100, 999}:
        known, front = {s}, {s}
        want.add((s, s, 0))
        for hop in (1, 2, 3):
            front = {b for a, b in edges if a in front} | {a for a, b in edges if b in front}
            front -= known
            known |= front
            want |= {(s, x, hop) for x in front}
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(want)
    one = G.neighbours(spark.createDataFrame(edges, "source int, target int"), spark.createDataFrame([(0,)], "name int"), 3)
    assert sorted(r.name for r in one.collect()) == sorted(n for s, n, _ in want if s == 0)


def test_bounds(spark):
    for bounds in ([], [3], [1, 4, 9], list(range(0, 200, 3))):
        table = F.array(*(F.lit(b) for b in bounds)) if bounds else F.array().cast("array<bigint>")
        got = [r.i for r in spark.range(-2, 210).select(G.bound_index(table, F.col("id"), len(bounds)).alias("i")).collect()]
        assert got == [sum(b <= v for b in bounds) for v in range(-2, 210)]
