"""Operators against brute force on small inputs."""

from datetime import datetime, timedelta
from functools import partial

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking as C
from corpusmill.operators import evaluation as E
from corpusmill.operators import graph as G
from corpusmill.operators import listing as L
from corpusmill.operators import stats as S

TEXTS = ["", "one", "Para one. Still one!\n\nPara two? Yes.\n" + "word " * 300, "x" * 1200, "a\n\n\n\nb", "Ünï 。次。" * 40, None]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_chunks_are_slices(spark):
    for spans in (partial(C.recursive_spans, size=100, overlap=10), partial(C.sentence_spans, size=100), partial(C.regex_spans, pattern=r"\s+")):
        rows = C.chunked(docs(spark), "doc_id", "text", spans).collect()
        for r in rows:
            assert r.text == TEXTS[r.doc_id][r.char_start : r.char_end]
        for i, t in enumerate(TEXTS):
            covered = {k for r in rows if r.doc_id == i for k in range(r.char_start, r.char_end)}
            assert all(k in covered for k, c in enumerate(t or "") if not c.isspace())


def test_chunk_sizes():
    for t in TEXTS:
        assert all(b - a <= 100 for a, b in C.recursive_spans(t or "", 100))
        assert all(b - a <= 100 for a, b in C.sentence_spans(t or "", 100))


def test_sections_and_paths(spark):
    text = "intro\n# A\nx\n## B\ny\n### C\nz\n# D\nw"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    sections = C.title_sections(d, "doc_id", "text").orderBy("chunk_index").collect()
    assert [r.text for r in sections] == ["intro", "# A\nx", "## B\ny\n### C\nz", "# D\nw"]
    paths = [r.path for r in C.heading_paths(d, "doc_id", "text").orderBy("n").collect()]
    assert paths == ["", "A", "A", "A > B", "A > B", "A > B > C", "A > B > C", "D", "D"]


def test_parents(spark):
    children = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 8, 14), (1, 2, 30, 40), (1, 3, 6, 7)], "doc_id long, chunk_index int, char_start int, char_end int")
    parents = spark.createDataFrame([(1, 0, 2, 6), (1, 1, 7, 20)], "doc_id long, chunk_index int, char_start int, char_end int")
    found = {r.chunk_index: r.parent_chunk_index for r in C.with_parents(children, parents, "doc_id").collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 0}


def test_rate_limit(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 10, 11, 12, 13, 30])] + [("b", t0, 99), (None, t0, 100)]
    got = {r.i: r.accepted for r in S.rate_limit(spark.createDataFrame(rows, "k string, t timestamp, i int"), "k", "t", "i", 2, 10.0).collect()}
    passed: list[float] = []
    for i, s in enumerate([0, 1, 2, 3, 10, 11, 12, 13, 30]):
        passed = [p for p in passed if s - p < 10]
        ok = len(passed) < 2
        passed += [s] if ok else []
        assert got[i] == ok
    assert got[99] and not got[100]


def test_text_functions(spark):
    row = spark.createDataFrame([("　Ａｃｍｅ 1 2 3 ", "<b>\"x\" & y", "```json\n{\"a\": 1}\n```", "so {\"a\": 2} there", "none")], "name string, html string, fenced string, bare string, bad string")
    r = row.select(T.normalized_name(F.col("name")).alias("n"), T.escaped_html(F.col("html")).alias("h"), *(T.json_object(F.col(c), "a int").alias(c) for c in ("fenced", "bare", "bad"))).first()
    assert (r.n, r.h) == ("Acme 123", "&lt;b&gt;&quot;x&quot; &amp; y")
    assert (r.fenced.a, r.bare.a, r.bad) == (1, 2, None)
    assert [x[0] for x in spark.createDataFrame([(0.0,), (None,), (3.0,), (0.2,)], "c double").select(T.clamped_confidence(F.col("c"))).collect()] == [0.5, 0.5, 1.0, 0.2]


def test_empty_lists_filter_everything(spark):
    d = docs(spark)
    assert d.where(L.visible(F.col("doc_id"), [])).count() == 0
    assert d.where(L.visible(F.col("doc_id"), "all")).count() == len(TEXTS)
    assert L.page(d, [F.asc("doc_id")], 2, 3).count() == 3


def test_graph_and_metrics(spark):
    found = spark.createDataFrame([("A", "t", "d1", 1, 0, 5), ("B", "t", "d2", 1, 0, 2), ("A", "t", "d3", 1, 0, 9), ("A", "t", "d4", 2, 0, 7)], "name string, type string, description string, doc_id int, chunk_index int, seq long")
    got = {r.name: (r.id, r["count"], r.description) for r in G.merged_entities(found).collect()}
    assert got == {"B": ("e1", 1, "d2"), "A": ("e2", 2, "d1；d4；d3")}
    v = spark.createDataFrame([([1, 0, 1],), ([0, 0],), ([],)], "v array<int>").select(E.average_precision(F.col("v")), E.share_true(F.col("v"))).collect()
    assert [tuple(None if x is None else round(x, 4) for x in r) for r in v] == [(0.8333, 0.6667), (0.0, 0.0), (None, None)]
    assert E.resolved(["faithfulness", "x", "faithfulness", "answer_relevancy"], embeddings=False) == (["faithfulness"], ["x"])


def test_context_functions(spark):
    from corpusmill.operators import context as X

    from corpusmill.operators import alignment as A

    assert A.aligned_spans("a  b\nc d e", ["a b", "x", "c  d", ""]) == [(0, 4), None, (5, 8), None]
    row = spark.createDataFrame([("abcdef", "xxabcd", "![i](p/q.png) ![j](http://h/z.png) ![k](n.gif)")], "a string, b string, m string")
    got = row.select(X.shared_share(F.col("a"), F.col("b")).alias("s"), X.rewritten_images(F.col("m"), "/f/").alias("m")).first()
    assert round(got.s, 4) == 0.3333 and got.m == "![i](/f/q.png) ![j](http://h/z.png) ![k](/f/n.gif)"
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "```", "b", "```", "c", "| x |", "| - |", "d", "| y |"])], "doc_id int, n int, piece string")
    assert [r.protected for r in X.fenced_lines(lines, "doc_id").orderBy("n").collect()] == [False, True, True, True, False, True, True, False, False]
