"""Versions of tables: all or nothing, whatever fails half way."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import graph as G
from corpusmill.operators import lifecycle as L
from corpusmill.sources import versions as V


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "a long")


def broken(df):
    """A table whose last rows fail while it is written."""
    return df.repartition(4, "a").select(F.when(F.col("a") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("a")).cast("long").alias("a"))


def test_swap_and_failure(spark, tmp_path):
    root = f"{tmp_path}/set"
    assert V.current(spark, root) is None and V.history(spark, root).count() == 0
    first = V.publish(spark, root, {"x": rows(spark, 1, 2), "y": rows(spark, 5)}, note="first")
    reader = V.current(spark, root).read(spark, "x")
    with pytest.raises(Exception, match="lost"):
        V.publish(spark, root, {"x": rows(spark, 7), "y": broken(rows(spark, 1, 2, 3))})
    at = V.current(spark, root)
    assert at == first and at.read(spark, "x").count() == 2 and at.read(spark, "y").count() == 1
    # a new version made from the one it replaces
    second = V.publish(spark, root, {"x": at.read(spark, "x").union(rows(spark, 9)), "y": at.read(spark, "y")}, base=at)
    assert second.number > first.number and V.current(spark, root).read(spark, "x").count() == 3
    assert reader.count() == 2 and V.current(spark, root, first.number) == first
    with pytest.raises(V.LostRace):
        V.publish(spark, root, {"x": rows(spark, 1)}, base=first)
    with pytest.raises(KeyError):
        second.read(spark, "z")
    assert [r.note for r in V.history(spark, root).orderBy("version").collect()] == ["first", None]
    assert V.forget(spark, root, keep=1) == [first.number] and V.current(spark, root, first.number) is None
    assert V.current(spark, root).read(spark, "x").count() == 3 and V.forget(spark, root, keep=1) == []
    assert spark.read.parquet(first.path("x")).count() == 0


def test_two_writers(spark, tmp_path):
    root = f"{tmp_path}/set"
    one = V.publish(spark, root, {"x": rows(spark, 1)})
    # another writer adds the same number with a greater token: the first row by token stays
    V._append(spark, root, V.Version(one.number, "z" * 32, one.tables, root), None, False)
    assert V.current(spark, root) == one and V.history(spark, root).count() == 1
    # and with a lesser one before we look: ours was not the one
    real, V._append = V._append, lambda s, r, v, n, f: (real(s, r, v, n, f), real(s, r, V.Version(v.number, "0", v.tables, r), n, f))
    try:
        with pytest.raises(V.LostRace):
            V.publish(spark, root, {"x": rows(spark, 2)})
    finally:
        V._append = real


def test_bases_of_vectors_are_replaced_at_once(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    with pytest.raises(FileNotFoundError):
        L.read_vectors(spark, path)
    made = spark.createDataFrame([("01", 1), ("01", 2), ("b", 3), (None, 4)], "kb_id string, a long")
    L.write_vectors(made, path)
    bad = made.where("kb_id = '01'").withColumn("a", F.when(F.col("a") == 2, F.raise_error(F.lit("lost"))).otherwise(F.lit(9)).cast("long"))
    with pytest.raises(Exception, match="lost"):
        L.write_vectors(bad, path)
    assert sorted(r.a for r in L.read_vectors(spark, path, "01").collect()) == [1, 2]
    L.write_vectors(spark.createDataFrame([("01", 7), ("c", 8)], "kb_id string, a long"), path)
    assert sorted(((r.kb_id, r.a) for r in L.read_vectors(spark, path).collect()), key=repr) == [("01", 7), ("b", 3), ("c", 8), (None, 4)]
    one = L.read_vectors(spark, path, "01")
    assert [tuple(r) for r in one.select("kb_id", "a").collect()] == [("01", 7)]
    assert "PartitionFilters: [isnotnull(kb_id" in one._jdf.queryExecution().toString().replace("\n", " ")


def test_graph_keeps_both_old_tables(spark, tmp_path):
    path = f"{tmp_path}/graph"
    G.write_graph(rows(spark, 1), rows(spark, 1), path)
    with pytest.raises(Exception, match="lost"):
        G.write_graph(rows(spark, 1, 2), broken(rows(spark, 1, 2, 3)), path)
    assert [t.count() for t in G.read_graph(spark, path, "a long", "b long")] == [1, 1]
