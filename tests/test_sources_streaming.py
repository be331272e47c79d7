"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F

from corpusmill.sources import files
from corpusmill.sources.tables import table
from corpusmill.streaming import state


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.txt").write_bytes("你好".encode("gbk"))
    (tmp_path / "c.txt").write_bytes(b"ok \xff\xff\x80")
    got = {r.path[-5:]: r.text for r in files.text_files(spark, f"file://{tmp_path}", "*.txt").collect()}
    assert got["a.txt"] == "héllo" and got["b.txt"] == "你好" and got["c.txt"].startswith("ok ")


def test_datasets(spark, tmp_path):
    (tmp_path / "d.csv").write_text('question,response,contexts,ground_truths\nq1,a1,"[""x"", ""y""]",t\nq2,a2,plain,\n')
    rows = files.dataset(spark, f"file://{tmp_path}/d.csv").orderBy("question").collect()
    assert [(r.answer, r.contexts, r.ground_truth) for r in rows] == [("a1", ["x", "y"], "t"), ("a2", ["plain"], None)]
    (tmp_path / "d.json").write_text(json.dumps({"samples": [{"question": "q", "answer": "a", "contexts": ["c"]}]}))
    assert files.dataset(spark, f"file://{tmp_path}/d.json", "json", "samples").first().contexts == ["c"]


def test_log_round_trip(spark, sf_dir, tmp_path):
    e = table(spark, sf_dir, "events").select("ts", F.lit("kb1").alias("kb_id"), F.col("event_type").alias("query"), F.array("user_id").alias("hits"))
    path = f"file://{tmp_path}/log"
    files.append_log(e, path)
    last = e.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    read = files.read_log(spark, path, "kb1", last, 1)
    assert read.count() == e.where(F.date_format("ts", "yyyy-MM-dd") == last).count()


def test_user_lines(spark):
    lines = spark.createDataFrame([(1, "ann,Ann,north,user"), (2, "# no"), (3, " "), (4, "ann,Again,north,user"), (5, "bob,Bob,west,user"), (6, ",x,north,user")], "line int, value string")
    departments = spark.createDataFrame([("north",)], "name string")
    got = {r.line: r.problem for r in files.user_lines(lines, departments).collect()}
    assert got == {1: None, 4: "repeated user", 5: "unknown department", 6: "no user"}


def _run(stream, name, spark, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, sf_dir, tmp_path):
    path = f"file://{tmp_path}/events"
    events = table(spark, sf_dir, "events")
    events.coalesce(1).write.parquet(path)
    source = spark.readStream.schema(events.schema).parquet(path)
    log = source.select("ts", F.lit("kb").alias("kb_id"), F.array("user_id").alias("hits"))
    days = {r.day: r.retrievals for r in _run(state.daily_counts(log), "days", spark, tmp_path, "complete").collect()}
    assert days == {r.day: r.n for r in events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    requests = source.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("id"))
    got = _run(state.rate_limited(requests, 2, 3600.0), "limited", spark, tmp_path)
    from corpusmill.operators.stats import rate_limit

    batch = rate_limit(events, "user_id", "ts", "event_id", 2, 3600.0)
    assert {(r.id, r.accepted) for r in got.collect()} == {(r.event_id, r.accepted) for r in batch.collect()}


def test_profile_memory(spark):
    rounds = spark.createDataFrame([("u", 1, "likes tea", 1.0), ("u", 1, "weak", 0.32), ("u", 2, "likes  tea", 0.5)], "user_id string, round int, content string, confidence double")
    got = {r.content: round(r.confidence, 4) for r in state.profile_memory(rounds).collect()}
    assert got == {"likes tea": 0.85}
