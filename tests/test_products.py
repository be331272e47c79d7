"""Searches by pages and blocks: equal to the plain search, copies and odd rows too, with no row for a pair."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import products
from corpusmill.operators import retrieval as R
from corpusmill.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """10,000 vectors without clusters: more cells than are asked first."""
    path = str(tmp_path_factory.mktemp("vectors"))
    x = np.random.default_rng(3).normal(size=(10_000, 16)).astype(np.float32)
    x[5000:5400] = x[50]  # copies of a query
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["vector_search", "indexed_vector_search"])
def test_search_of_all_vectors(name, spark, vectors):
    got = QUERIES[name](spark, vectors).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{vectors}/embeddings.parquet/*.parquet'")
    key = lambda r: (r[0], r[3], r[1], round(r[2], 9))
    assert sorted(map(key, got)) == sorted(map(key, con.sql(ORACLE_SQL[name]).fetchall()))


def test_no_row_for_a_pair(spark, vectors):
    rows = spark.read.parquet(f"{vectors}/embeddings.parquet")
    plan = R.vector_search(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "vec_id", "embedding", 10)
    assert "MapInArrow" in plan._jdf.queryExecution().toString()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [-1.0, 0.0]), (8, [inf, 1.0])], "id int, v array<double>")
    got = {r.chunk_id: r.score for r in R.vector_search(rows, rows.where("id = 1").select(F.col("id").alias("query_id"), F.col("v").alias("vector")), "id", "v", 10).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 6, 7)} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 6: None, 7: -1.0} and np.isnan(got[5]) and np.isnan(got[8])


def test_keyword_search_of_many(spark):
    words = [" ".join(f"w{(i * j) % 37}" for j in range(1, 9)) for i in range(60)] + ["w1 w2 w3"] * 30
    rows = spark.createDataFrame(list(enumerate(words)), "id int, text string")
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("q"), "text")
    plain = R.top(R._scored(rows, asked, "id", "text", "q", "text"), 5).collect()
    found = R.bm25(rows, asked.unionByName(asked), "id", "text", "q", "text", 5).collect()  # a query that stands twice is one
    assert sorted(map(tuple, found)) == sorted(map(tuple, plain))


def test_best_of_pages():
    rng, best = np.random.default_rng(1), products.Best(3)
    scores = rng.normal(size=(5, 40))
    found = set()
    for a in range(0, 40, 8):
        q, r = best.among("b", scores[:, a : a + 8], 0.0)
        found |= set(zip(q.tolist(), (r + a).tolist()))
    assert len(best.among("b", scores[:, :8] - 100, 0.0)[0]) == 0
    assert {(q, r) for q in range(5) for r in np.argsort(-scores[q])[:3].tolist()} <= found and len(found) < 100
