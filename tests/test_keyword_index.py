"""The stored keyword index against the exact search, through additions, removals and merges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import keyword_index as K
from corpusmill.operators import retrieval as R
from corpusmill.sources import versions

SCHEMA = "id long, text string"


def texts(rng, n, start=0):
    # common and rare words, as in a language
    return [(start + i, " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randrange(0, 60)))) for i in range(n)]


def same(spark, path, rows, queries, top_k=5):
    exact = R.bm25(spark.createDataFrame(rows, SCHEMA), queries, "id", "text", "q", "text", top_k)
    found = K.search(spark, path, queries, "q", "text", top_k)
    want = sorted(map(tuple, exact.collect()))
    assert want and sorted(map(tuple, found.collect())) == want
    return found


def test_life_of_an_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "PAGE", 50)
    rng, path = random.Random(2), f"{tmp_path}/ix"
    rows = dict(texts(rng, 400)) | {900: None, 901: "", 902: "the of", 903: "über Straße 北京大学 über"}
    queries = spark.createDataFrame([(1, "w1 w7 w90"), (2, "w2 w2 w399 w3"), (3, None), (4, "the"), (5, "nothing known here"), (6, "über 北京"), (7, " ".join(f"w{i}" for i in range(1, 60)))], "q int, text string")
    K.build(spark.createDataFrame(list(rows.items()), SCHEMA), path, "id", "text")
    same(spark, path, list(rows.items()), queries)
    # chunks added, some of them in place of others
    new = texts(rng, 120, start=350)
    rows |= dict(new)
    K.added(spark.createDataFrame(new, SCHEMA), path, "id", "text")
    same(spark, path, list(rows.items()), queries)
    # removed, one of them twice over, one that was never there
    gone = [5, 5, 360, 903, 7777]
    K.removed(spark.createDataFrame([(i,) for i in gone], "id long"), path, "id")
    rows = {i: t for i, t in rows.items() if i not in gone}
    same(spark, path, list(rows.items()), queries)
    # added again after its removal
    rows |= {5: "w1 w1 w1 w90", 360: "w7"}
    K.added(spark.createDataFrame([(i, rows[i]) for i in (5, 360)], SCHEMA), path, "id", "text")
    same(spark, path, list(rows.items()), queries)
    assert len(K.read(spark, path).version.read(spark, "segments").collect()) == 4
    K.merged(spark, path)
    assert len(K.read(spark, path).version.read(spark, "segments").collect()) == 1
    same(spark, path, list(rows.items()), queries)
    counts = {r.term: r.df for r in K.read(spark, path).terms.collect()}
    assert counts == {t: sum(t in (x or "").split() for x in rows.values()) for t in counts}


def test_a_failed_addition_changes_nothing(spark, tmp_path):
    path, rows = f"{tmp_path}/ix", [(1, "red fox"), (2, "red hen")]
    K.build(spark.createDataFrame(rows, SCHEMA), path, "id", "text")
    bad = spark.createDataFrame([(3, "red cow"), (4, "x")], SCHEMA).withColumn("text", F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        K.added(bad, path, "id", "text")
    same(spark, path, rows, spark.createDataFrame([(1, "red fox")], "q int, text string"))
    with pytest.raises(FileNotFoundError):
        K.read(spark, f"{tmp_path}/none")


def test_only_folders_of_the_terms_are_read(spark, tmp_path):
    path = f"{tmp_path}/ix"
    rows = texts(random.Random(3), 300)
    K.build(spark.createDataFrame(rows, SCHEMA), path, "id", "text")
    one = spark.createDataFrame([(1, "w17")], "q int, text string")
    seen = []
    real, K.written = K.written, lambda df, name: (seen.append((name, df)), real(df, name))[1]
    try:
        same(spark, path, rows, one)
    finally:
        K.written = real
    plan = dict(seen)["blocks"]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan) and K.read(spark, path).postings.select("bucket").distinct().count() > 10


def test_blocks_that_cannot_matter_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "PAGE", 20)
    path = f"{tmp_path}/ix"
    rows = [(i, "common filler words " + ("rare " * 5 if i % 100 == 0 else "") + "pad " * (i % 7)) for i in range(1000)]
    K.build(spark.createDataFrame(rows, SCHEMA), path, "id", "text")
    seen = {}
    real, K.written = K.written, lambda df, name: seen.setdefault(name, real(df, name))
    try:
        same(spark, path, rows, spark.createDataFrame([(1, "rare common filler")], "q int, text string"))
    finally:
        K.written = real
    # the common words cannot lift a chunk over the ones with the rare word: they give no candidates
    assert [r.term for r in seen["needed"].collect()] == ["rare"]


def test_empty_index(spark, tmp_path):
    path, queries = f"{tmp_path}/ix", spark.createDataFrame([(1, "red")], "q int, text string")
    K.build(spark.createDataFrame([], SCHEMA), path, "id", "text")
    assert K.search(spark, path, queries, "q", "text", 3).collect() == []
    K.added(spark.createDataFrame([(1, "red")], SCHEMA), path, "id", "text")
    assert [tuple(r) for r in K.search(spark, path, queries, "q", "text", 3).collect()] == [(1, 1, pytest.approx(0.287682), 1)]
    K.removed(spark.createDataFrame([(1,)], "id long"), path, "id")
    assert K.search(spark, path, queries, "q", "text", 3).collect() == [] and versions.history(spark, path).count() == 3
