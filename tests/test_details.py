"""Settings of pages, groups in order, sources of odd queries."""

import pytest

from corpusmill.operators import context as X
from corpusmill.operators import lifecycle as L
from corpusmill.operators import listing


@pytest.mark.parametrize("pages", [[], None, "1-2", [[1]], [[0, 1]], [[2, 1]], [[1, True]], [[1.0, 2]], [[1, 2], 3]])
def test_pages_that_are_none(pages):
    with pytest.raises(ValueError):
        L.checked_pages(pages)


def test_pages(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 9, None)], "page int")
    assert [r.page for r in L.in_pages(rows, [[1, 2], [5, 5]]).collect()] == [1, 2, 5]
    assert L.ChunkSettings(pages=((1, 3),)).pages == ((1, 3),)
    with pytest.raises(ValueError):
        L.ChunkSettings(pages=((3, 1),))


def test_groups_in_order(spark):
    rows = spark.createDataFrame([("b", "k2", "K2", 1, 0), ("a", "k1", "K1", 2, 1), ("b", "k3", "K3", 3, 2), ("b", "k2", "K2", 4, 3), (None, "k9", "K9", 5, 4), ("zz", "k8", "K8", 6, 5)], "department_id string, kb_id string, kb_name string, doc_id long, n int")
    departments = spark.createDataFrame([("a", "A", 2), ("b", "B", 1), ("empty", "E", 0)], "department_id string, department_name string, created_at int")
    got = [(r.department_id, r.department_name, [(b.kb_name, b.docs) for b in r.bases]) for r in listing.nested(rows, departments).orderBy("place").collect()]
    assert got == [("b", "B", [("K2", [1, 4]), ("K3", [3])]), ("a", "A", [("K1", [2])]), ("zz", "未分配部门", [("K8", [6])]), (None, "未分配部门", [("K9", [5])])]


def test_graph_source_of_a_query_without_hits(spark):
    sources = spark.createDataFrame([(1, 1, "c", "d", "t", 0.5)], "query_id int, rank int, chunk_id string, document_name string, text string, score double")
    graph = spark.createDataFrame([(1, "g"), (2, "h"), (3, " "), (4, None)], "query_id int, context string")
    got = {(r.query_id, r["rank"], r.chunk_id) for r in X.with_graph_source(sources, graph).collect()}
    assert got == {(1, 1, "c"), (1, 2, "kg:1"), (2, 1, "kg:2")}
