"""The vector index: all vectors are in it, recall against the exact search, additions, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import retrieval as R
from corpusmill.operators import vector_index as I
from corpusmill.sources import versions


def held(spark, path):
    index = versions.current(spark, path)
    return sorted(r.id for r in index.read(spark, "pages").select(F.explode("ids").alias("id")).collect())


def recall(found, exact):
    want = {(r.query_id, r.chunk_id): r.score for r in exact.collect()}
    got = {(r.query_id, r.chunk_id): r.score for r in found.collect()}
    assert len(got) == len(want) and all(want[k] == s for k, s in got.items() if k in want)
    return sum(k in want for k in got) / len(want)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    at = rng.normal(size=(40, 24))
    rows = [(i, (at[rng.integers(40)] + 0.4 * rng.normal(size=24)).tolist()) for i in range(3000)]
    path = f"{tmp_path_factory.mktemp('index')}/ix"
    table = spark.createDataFrame(rows, "id long, v array<double>").withColumn("v", F.col("v").cast("array<float>")).cache()
    I.build(table, path, "id", "v")
    return table, path


def asked(table, every):
    return table.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("v").alias("vector"))


def test_recall_and_all_rows(spark, clustered):
    table, path = clustered
    assert held(spark, path) == list(range(3000))
    queries = asked(table, 50)
    exact = R.vector_search(table, queries, "id", "v", 10)
    found = I.search(spark, path, queries, 10, probes=8)
    assert recall(found, exact) >= 0.9
    assert recall(I.search(spark, path, queries, 10, probes=10_000), exact) == 1.0
    # of 55 cells only the asked ones are read
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()


def test_additions(spark, clustered, tmp_path, monkeypatch):
    table, _ = clustered
    monkeypatch.setattr(I, "PAGE", 64)
    monkeypatch.setattr(I, "BLOCK", 7)
    path = f"{tmp_path}/ix"
    I.build(table.where("id < 1000"), path, "id", "v")
    new = table.where("id >= 900 AND id < 1400").withColumn("v", F.when(F.col("id") == 950, F.transform("v", lambda x: -x)).otherwise(F.col("v")))
    I.added(new, path, "id", "v")
    assert held(spark, path) == list(range(1400))
    now = table.where("id < 900").unionByName(new)
    queries = asked(now, 50)
    assert recall(I.search(spark, path, queries, 5, probes=10_000), R.vector_search(now, queries, "id", "v", 5)) == 1.0


def test_odd_vectors(spark, tmp_path):
    path = f"{tmp_path}/ix"
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, None]), ("e", [float("nan"), 1.0]), ("f", []), ("g", [-1.0, 0.0]), ("h", [2.0, 0.0])]
    I.build(spark.createDataFrame(rows, "id string, v array<float>"), path, "id", "v", cells=2)
    assert held(spark, path) == ["a", "b", "g", "h"]
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0])], "query_id int, vector array<double>")
    got = [tuple(r) for r in I.search(spark, path, queries, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a", 1.0, 1), (1, "h", 1.0, 2), (1, "b", 0.0, 3), (2, "a", 0.0, 1), (2, "b", 0.0, 2), (2, "g", 0.0, 3)]
    with pytest.raises(ValueError):
        I.search(spark, path, spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>"), 1)
    with pytest.raises(ValueError):
        I.build(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, v array<float>"), path, "id", "v")
    with pytest.raises(ValueError):
        I.added(spark.createDataFrame([("a", [1.0])], "id string, v array<float>"), path, "id", "v")


def test_copies_and_no_rows(spark, tmp_path):
    I.build(spark.range(300).select("id", F.array(F.lit(0.5), F.lit(1.5)).alias("v")), f"{tmp_path}/same", "id", "v")
    one = spark.createDataFrame([(1, [1.0, 3.0])], "query_id int, vector array<double>")
    assert [r.chunk_id for r in I.search(spark, f"{tmp_path}/same", one, 3, widen=100).orderBy("rank").collect()] == [0, 1, 2]
    I.build(spark.range(0).select("id", F.array(F.lit(0.5)).alias("v")), f"{tmp_path}/none", "id", "v")
    assert I.search(spark, f"{tmp_path}/none", one.select("query_id", F.slice("vector", 1, 1).alias("vector")), 3).collect() == []
