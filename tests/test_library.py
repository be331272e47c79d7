"""Graph, text, lifecycle, prompt and retrieval operators on small tables."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import graph as G
from corpusmill.operators import lifecycle as X
from corpusmill.operators import listing as L
from corpusmill.operators import prompts as P
from corpusmill.operators import retrieval as R
from corpusmill.functions.vectors import sign_histogram
from corpusmill.streaming import state as ST

FENCED = """ok ```json
{"entities":[{"name":"Ａlan","type":"人物","description":"  x "},{"name":"Alan","type":"技术"},{"name":"B","type":"bad"},{"name":"C","type":"概念"},{"type":"概念"}],"relations":[{"source":"Alan","target":"C","type":"提出"},{"source":"C","target":"C","type":"提出"},{"source":"C","target":"Z","type":"提出"}]}
``` more"""
TRAILED = 'pre {"entities":[{"name":"A}","type":"概念","description":"q\\"}"}],"relations":[]} post {'


def test_extraction_is_checked(spark):
    rows = spark.createDataFrame([(1, FENCED), (2, 'say {"entities": [], "relations": []} }'), (3, "nothing"), (4, None), (5, TRAILED), (6, '{"entities": 5}')], "id int, a string")
    got = {r.id: r for r in G.extracted(rows, ["id"], "a").collect()}
    assert [tuple(e) for e in got[1].entities] == [("Alan", "人物", "x"), ("C", "概念", "")] and [(r.source, r.target, r.type) for r in got[1].relations] == [("Alan", "C", "提出")]
    assert got[2].entities == [] and got[3].entities is None and got[4].relations is None and got[6].entities is None
    assert [tuple(e) for e in got[5].entities] == [("A}", "概念", 'q"}')]


def test_names_of_a_question(spark):
    rows = spark.createDataFrame([('```json\n["Ｘ 1","X 1", 5, {"a":1}, "", "' + "y" * 40 + '"]\n```',), ('so: ["a","b]","c","d","e","f"] ok',), ("none",), (None,)], "a string")
    assert [r[0] for r in rows.select(T.entity_names(F.col("a"))).collect()] == [["X 1", "y" * 30], ["a", "b]", "c", "d", "e"], [], []]


def test_terms_of_chinese_text(spark):
    rows = spark.createDataFrame([("知识图谱 and Foo the x2",), ("图 一个 的",), (None,)], "a string")
    assert [r[0] for r in rows.select(T.terms(F.col("a"))).collect()] == [["知识", "识图", "图谱", "foo", "x2"], [], []]


def test_small_text_functions(spark):
    r = spark.range(1).select(
        T.chinese_count(F.lit(12345)).alias("a"), T.chinese_count(F.lit(99)).alias("b"), T.valid_day(F.lit("2024-02-30")).alias("c"), T.valid_day(F.lit("2024-02-29")).alias("d"),
        T.day_of_path(F.lit("/a/b-2024-01-05.jsonl")).cast("string").alias("e"), T.day_of_path(F.lit("/a/b.jsonl")).alias("f"), T.image_bytes(F.lit("data:image/png;base64,aGk=")).alias("g"), T.image_bytes(F.lit("%%")).alias("h"),
        T.merged_setting(F.lit(" "), F.lit("g")).alias("i"), T.embedding_text(F.lit(" c "), F.lit("t")).alias("j"), T.is_numbered_heading(F.lit("第三章 x")).alias("k"), T.is_numbered_heading(F.lit("三、x")).alias("l"),
    ).first()
    assert tuple(r) == ("1.2 万字", "99 字", False, True, "2024-01-05", None, b"hi", None, "g", "【上下文】c\nt", True, True)


def test_graph_context_and_storage(spark, tmp_path):
    rel = spark.createDataFrame([(1, "a", "b", "t", "x" * 70, 1), (1, "b", "c", "t", None, 2)], "q int, source string, target string, type string, description string, n int")
    ent = spark.createDataFrame([(1, "a", "t", "d\ne", 3, 1), (1, "b", "t", "", 2, 2)], "q int, name string, type string, description string, count int, n int")
    assert G.context_lines(ent, rel, "q", most_entities=1).first().context == "【知识图谱实体】\na(t|d e|3)\n【知识图谱关系】\na|t|b|" + "x" * 60 + "…\nb|t|c|"
    counts, start = ent.select("name", "count"), spark.createDataFrame([("a",)], "name string")
    assert G.shown_network(rel, counts, start, 2, 3).count() == 2 and G.shown_network(rel, counts, start, 2, 2).count() == 1
    seen = spark.createDataFrame([("a", "t2", "e2", 5), ("a", "t1", "e1", 1)], "name string, type string, id string, first_seen int")
    assert {(r.source, r.source_id, r.target_id) for r in G.with_ids(rel, seen).collect()} == {("a", "e1", None), ("b", None, None)}
    path = f"{tmp_path}/graph"
    G.write_graph(ent, rel, path)
    assert [t.count() for t in G.read_graph(spark, path, "a int", "b int")] == [2, 2]
    assert [t.count() for t in G.read_graph(spark, f"{tmp_path}/none", "a int", "b int")] == [0, 0]
    (tmp_path / "bad").mkdir()
    for part in ("entities", "relations"):
        (tmp_path / "bad" / part).mkdir()
        (tmp_path / "bad" / part / "part-0.parquet").write_text("junk")
    assert [t.columns for t in G.read_graph(spark, f"{tmp_path}/bad", "a int", "b int")] == [["a"], ["b"]]
    one = spark.createDataFrame([("A", "t"), ("Turing", "t")], "name string, type string")
    asked = spark.createDataFrame([("alan turing",), ("u",)], "asked string")
    assert [(r.asked, r.name) for r in G.matched(one, asked).collect()] == [("alan turing", "Turing")]


def test_retrieve(spark):
    chunks = spark.createDataFrame([(1, "red fox runs", [1.0, 0.0], True), (2, "red hen sits", [0.9, 0.1], False), (3, "blue whale", [0.0, 1.0], None), (4, "red fox sleeps", [0.8, 0.2], True)], "chunk_id long, text string, embedding array<float>, doc_active boolean")
    asked = spark.createDataFrame([(7, "red fox", [1.0, 0.0]), (8, None, [0.0, 1.0])], "query_id long, text string, vector array<float>")
    got = R.retrieve(chunks, asked, top_k=2, dim=2)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == {(7, 1, 1), (7, 4, 2), (8, 3, 1), (8, 4, 2)}
    swap = lambda hits: hits.select("query_id", "chunk_id", F.length("chunk_text").cast("double").alias("rerank_score"))
    got = R.retrieve(chunks, asked, top_k=1, rerank_top=3, reranker=swap)
    assert {(r.query_id, r.chunk_id) for r in got.collect()} == {(7, 4), (8, 4)}
    with pytest.raises(ValueError):
        R.retrieve(chunks, asked, dim=3)
    two = R.fields_search(chunks.withColumn("title", F.when(F.col("chunk_id") == 3, "red")), asked, "chunk_id", {"text": 1.0, "title": 2.0}, "query_id", "text", 4)
    assert two.where("rank = 1 AND query_id = 7").first().chunk_id == 3


def test_vector_search_in_blocks(spark, monkeypatch):
    v = spark.range(200).select(F.col("id").alias("vec"), F.array(F.col("id").cast("double"), F.lit(50.0)).alias("e"))
    asked = v.where("vec % 20 = 0").select(F.col("vec").alias("query_id"), F.col("e").alias("vector"))
    whole = sorted(map(tuple, R.vector_search(v, asked, "vec", "e", 3).collect()))
    monkeypatch.setattr(R, "BROADCAST_BYTES", 150)
    found = R.vector_search(v, asked, "vec", "e", 3)
    assert sorted(map(tuple, found.collect())) == whole and "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_ingestion_and_rebuild(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x\ny"), (2, "a", " "), (3, "b", None), (4, "b", " "), (5, "b", "Q: a\n\nb")], "doc_id long, kb_id string, text string")
    from corpusmill.operators import chunking as C

    chunk = lambda d: C.chunked(d, "doc_id", "text", lambda t: C.regex_spans(t, r"\n+"))
    vectors, report = X.ingested(docs, chunk, sign_histogram, 64)
    assert {r.doc_id: (r.status, r.error, r.chunks) for r in report.collect()} == {1: ("ingested", None, 2), 2: ("failed", "no text", 0), 3: ("failed", "no text", 0), 4: ("failed", "no chunks", 0), 5: ("ingested", None, 2)}
    assert {r.doc_id: r.error for r in X.ingested(docs, chunk, sign_histogram, 64, qa_only=True)[1].collect()}[1] == "no questions and answers"
    assert {r.error for r in X.ingested(docs, chunk, sign_histogram, 3)[1].collect()} == {"vectors of another size", "no text", "no chunks"}
    path = f"{tmp_path}/vectors"
    X.write_vectors(vectors, path)
    X.write_vectors(vectors.where("kb_id = 'b' AND chunk_index = 0"), path)  # one base anew, the other stays
    assert X.read_vectors(spark, path).count() == 3 and X.read_vectors(spark, path, "a").count() == 2
    state = docs.select("doc_id", F.lit("ingested").alias("status")).where("doc_id <> 2")
    own = spark.createDataFrame([(3, 0, "t", "c")], "doc_id long, chunk_index int, text string, context string")
    made, told = X.rebuilt(X.read_vectors(spark, path), own, state, sign_histogram)
    assert {r.doc_id: (r.done, r.error) for r in told.collect()} == {1: (2, None), 3: (1, None), 4: (0, "no text"), 5: (1, None)}
    assert made.where("doc_id = 3").first().text == "【上下文】c\nt"


def test_settings_and_rights(spark):
    assert X.ChunkSettings(chunk_size=50, overlap=49).overlap == 49
    for bad in ({"chunk_size": 49}, {"overlap": 500}, {"level": 7}, {"parent_size": 1}):
        with pytest.raises(ValueError):
            X.ChunkSettings(**bad)
    rows = spark.createDataFrame([("d", "user", "d"), ("d", "dept_admin", "d"), ("e", "dept_admin", "d"), (None, "super_admin", None), ("", "user", ""), (None, "user", "d")], "base string, role string, dept string")
    got = rows.select(X.readable(F.col("base"), F.col("role"), F.col("dept")), X.manageable(F.col("base"), F.col("role"), F.col("dept"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (False, False), (True, True), (False, False), (False, False)]


def test_free_names(spark):
    fresh = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "b"), (4, "a.md"), (5, "c(1).md")], "doc_id long, name string")
    held = spark.createDataFrame([("a.md",), ("a(2).md",), ("x.md",)], "name string")
    assert {r.doc_id: r.name for r in L.free_names(fresh, held, "doc_id").collect()} == {1: "a(1).md", 2: "a(3).md", 3: "b", 4: "a(4).md", 5: "c(1).md"}


def test_texts_for_prompts(spark):
    s = spark.createDataFrame([(1, 2, "n", 5, "b" * 10, None, "ctx"), (1, 1, None, 4, "a", "par", None), (1, 3, "z", 6, " ", "", "")], "query_id int, rank int, document_name string, doc_id int, text string, parent_text string, context string")
    r = P.reference_texts(s, most_chars=6).first()
    assert r.refs == "[引用 1]（来源：4）\npar\n\n[引用 2]（来源：n）\n【上下文】ctx\nbbbbbb\n\n[引用 3]（来源：z）\n " and r.knowledge == "par\n\n" + "b" * 10
    t = spark.createDataFrame([("",), ("{knowledge}+{memory}",), ("plain {memory}",), (None,)], "t string")
    got = [x[0] for x in t.select(P.system_text(F.col("t"), F.lit("R"), F.lit("K"), F.lit("M"))).collect()]
    assert got == ["M\n\nR", "K+M", f"plain M\n\n{P.CITATION_RULE}\n[引用]\nR", "M\n\nR"]
    docs = spark.createDataFrame([(1, "# h\nx"), (2, "Q: a\n\nb"), (3, "plain"), (4, "p" * 30_000), (5, None), (6, "第一章 x\ny")], "doc_id long, text string")
    assert {r.doc_id: (r.method, r.with_context) for r in P.profiles(docs, "doc_id", "text").collect()} == {1: ("parent_child", False), 2: ("qa", False), 3: ("naive", True), 4: ("naive", False), 5: ("naive", True), 6: ("parent_child", False)}


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2024-01-05 10:00:00 [INFO] x\nnot a line\n2024-01-06 10:00:00 [WARN] y\n")
    ST.write_daily(ST.log_lines(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    (tmp_path / "in" / "b.log").write_text("2024-01-06 11:00:00 [INFO] z\n")
    ST.write_daily(ST.log_lines(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((str(r.day), r.message) for r in out.collect()) == [("2024-01-05", "x"), ("2024-01-06", "y"), ("2024-01-06", "z")]
    assert X.retained(out, "day", F.lit("2024-01-06").cast("date"), 1).count() == 2
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(9)] + [(9, " ")], "line int, value string")
    assert [r.line for r in X.log_tail(lines, 2, 3).collect()] == [8, 7, 6]
