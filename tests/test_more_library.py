"""Datasets, logs, reports, memory and scopes on small inputs."""

import json

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import evaluation as E
from corpusmill.operators import listing as L
from corpusmill.operators import prompts as P
from corpusmill.sources import files


def test_datasets_of_columns_and_missing_values(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"question": ["a", "b"], "response": ["x", None], "contexts": [["c"], []], "ground_truths": [["g", "h"], []]}))
    rows = files.dataset(spark, f"{tmp_path}/c.json", "json").orderBy("question").collect()
    assert [tuple(r) for r in rows] == [("a", "x", ["c"], "g"), ("b", None, [], None)]
    (tmp_path / "d.csv").write_text('question,answer,context\nq1,NaN,"[""u"", ""v""]"\nq2, nan ,w\n')
    rows = files.dataset(spark, f"{tmp_path}/d.csv").orderBy("question").collect()
    assert [tuple(r) for r in rows] == [("q1", None, ["u", "v"], None), ("q2", None, ["w"], None)]


def test_logs_by_day(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-05 10:00:00", "c", "s", "q" * 200, "a" * 5000)], "t string, config_id string, session_id string, query string, answer string").withColumn("ts", F.col("t").cast("timestamp"))
    files.append_queries(e, f"{tmp_path}/q")
    r = spark.read.json(f"{tmp_path}/q").first()
    assert (len(r.query), len(r.answer), str(r.dt)) == (100, 4000, "2024-01-05")
    a = e.select("ts", *(F.lit("x").alias(c) for c in ("user_id", "action", "target_id", "ip", "status")), F.col("answer").alias("detail"))
    files.append_audit(a, f"{tmp_path}/a")
    files.append_audit(a, f"{tmp_path}/a")
    assert [len(r.detail) for r in spark.read.json(f"{tmp_path}/a").collect()] == [1000, 1000]


def test_relevancy_and_reports(spark):
    v = spark.createDataFrame([([1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], [0, 1]), ([1.0, 0.0], [[1.0, 0.0]], [1]), ([1.0, 0.0], [], [])], "q array<double>, a array<array<double>>, e array<int>")
    assert [r[0] for r in v.select(E.answer_relevancy(F.col("q"), F.col("a"), F.col("e"))).collect()] == [0.5, 0.0, None]
    s = spark.createDataFrame([("t", 1, "m<", 0.5), ("t", 0, "m<", None), ("t", 1, "b", 0.25)], "task string, idx int, metric string, score double")
    assert E.html_reports(s, "task").first().html == "<table><tr><td>0</td><td>m&lt;: -</td></tr><tr><td>1</td><td>b: 0.2500</td><td>m&lt;: 0.5000</td></tr></table>"


def test_memory_items(spark):
    rows = spark.createDataFrame([('```json\n[{"type":"profile","content":" a ","confidence":2},{"type":"x","content":""},{"type":"preference","content":"b"}]\n```',), ('{"items":[{"type":"profile","content":"c","confidence":0.2}]}',), ("none",), (None,)], "a string")
    got = [[tuple(x) for x in r[0]] for r in rows.select(T.memory_items(F.col("a"))).collect()]
    assert got == [[("profile", "a", 1.0), ("preference", "b", 0.5)], [("profile", "c", 0.2)], [], []]


def test_lists_and_scopes(spark):
    d = spark.createDataFrame([(1, "a", False, 5, None), (2, "a", False, 9, None), (3, "b", True, 1, 4), (4, "a", True, 1, 7)], "doc_id int, kb_id string, deleted boolean, created_at int, deleted_at int")
    assert [r.doc_id for r in L.listed(d, "a").collect()] == [2, 1] and [r.doc_id for r in L.listed(d, trash=True).collect()] == [4, 3]
    assert L.in_scope(d, "user", "a", "kb_id").count() == 3 and L.in_scope(d, "super_admin", None, "kb_id").count() == 4
    assert [(r.doc_id, r.total) for r in L.paged(d, [F.asc("doc_id")], 2, 3).collect()] == [(4, 4)]
    m = spark.createDataFrame([(1, 0, "user", "hi", None), (1, 1, "assistant", "yo", [("n", "z" * 600)])], "conv_id int, turn int, role string, text string, sources array<struct<document_name:string,text:string>>")
    assert P.session_markdown(m).first().markdown == "**user** hi\n\n**assistant** yo\n\n> [1] n：" + "z" * 500
