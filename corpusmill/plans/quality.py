"""Queries over logs: retrieval statistics, daily series, sampling of questions, conversation history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as S
from ..sources.tables import table
from .registry import query

#: A retrieval log from events: the query is the event's kind and k, the hits are two documents or none.
LOG_SQL = """(SELECT event_id AS seq, ts, 'kb' || (user_id % 3) AS kb_id, event_type || ' ' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS query,
  CASE WHEN event_id % 10 = 0 THEN []::BIGINT[] ELSE [user_id % 400, (user_id + event_id) % 400] END AS hits FROM events)"""


def retrieval_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hits = F.when(F.col("event_id") % 10 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("user_id") % 400, (F.col("user_id") + F.col("event_id")) % 400))
    return e.select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("kb"), (F.col("user_id") % 3).cast("string")).alias("kb_id"), F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query"), hits.alias("hits"))


@query(f"SELECT kb_id, count(*) AS retrievals, round(avg(len(hits)), 2) AS avg_hits, count(*) FILTER (len(hits) = 0) AS zero_hits FROM {LOG_SQL} GROUP BY kb_id")
def retrieval_totals(spark, sf_dir):
    return S.totals(retrieval_log(spark, sf_dir))


@query(f"""SELECT d.doc_id, coalesce(x.source, CAST(d.doc_id AS VARCHAR)) AS name, hits FROM (SELECT doc_id, count(*) AS hits, min(seq) AS first_seen FROM (SELECT unnest(hits) AS doc_id, seq FROM {LOG_SQL}) GROUP BY doc_id ORDER BY hits DESC, first_seen, doc_id LIMIT 10) d
LEFT JOIN documents x ON x.doc_id = d.doc_id""")
def hit_ranking(spark, sf_dir):
    """A report of the ten most often hit documents."""
    top = S.hit_ranking(retrieval_log(spark, sf_dir), 10)
    names = table(spark, sf_dir, "documents").select("doc_id", "source")
    return names.join(F.broadcast(top), "doc_id", "right").select("doc_id", F.coalesce("source", F.col("doc_id").cast("string")).alias("name"), "hits")


@query(f"SELECT doc_id FROM documents WHERE doc_id % 6 IN (2, 5) AND doc_id NOT IN (SELECT unnest(hits) FROM {LOG_SQL})")
def zero_hit_documents(spark, sf_dir):
    ingested = table(spark, sf_dir, "documents").where("doc_id % 6 IN (2, 5)").select("doc_id")
    return ingested.join(retrieval_log(spark, sf_dir).select(F.explode("hits").alias("doc_id")).distinct(), "doc_id", "left_anti")


@query(f"""WITH days AS (SELECT CAST(unnest(generate_series((SELECT CAST(max(ts) AS DATE) FROM events) - INTERVAL 29 DAY, (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY)) AS DATE) AS day),
n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS retrievals, count(*) FILTER (len(hits) > 0) AS hit FROM {LOG_SQL} GROUP BY 1)
SELECT strftime(days.day, '%Y-%m-%d') AS day, coalesce(retrievals, 0) AS retrievals, coalesce(round(hit / retrievals, 4), 0.0) AS hit_rate FROM days LEFT JOIN n ON n.day = days.day""")
def daily_quality(spark, sf_dir):
    return S.daily(retrieval_log(spark, sf_dir), 30)


@query(f"""SELECT round(sum(retrievals * rate) / sum(retrievals), 4) AS hit_rate, sum(retrievals)::BIGINT AS retrievals FROM (SELECT count(*) AS retrievals, round(count(*) FILTER (len(hits) > 0) / count(*), 4) AS rate FROM {LOG_SQL} GROUP BY CAST(ts AS DATE))""")
def overall_hit_rate(spark, sf_dir):
    days = retrieval_log(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("retrievals"), F.round(F.count_if(F.size("hits") > 0) / F.count("*"), 4).alias("rate"))
    return days.agg(F.round(F.sum(F.col("retrievals") * F.col("rate")) / F.sum("retrievals"), 4).alias("hit_rate"), F.sum("retrievals").alias("retrievals"))


@query(f"SELECT query, kb_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY kb_id, query ORDER BY ts DESC, seq DESC) AS r FROM {LOG_SQL}) WHERE r = 1")
def sample_from_logs(spark, sf_dir):
    return S.latest(retrieval_log(spark, sf_dir), ["kb_id", "query"], [F.desc("ts"), F.desc("seq")]).select("query", "kb_id", "seq")


@query("""SELECT conv_id, turn, question, answer FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY conv_id DESC, turn DESC) AS r FROM (
SELECT conv_id, turn, role, trim(text) AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant' AND question <> '') WHERE r = 1""")
def sample_from_chat(spark, sf_dir):
    return S.question_answer_pairs(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def last_rounds(spark, sf_dir):
    """The last three rounds of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(order)).where("r <= 6").select("conv_id", "turn", "role")


@query("""SELECT event_type AS level, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(event_id) AS last_line FROM events GROUP BY ALL""")
def log_levels(spark, sf_dir):
    """Runtime log lines, written and parsed again, counted by level and day."""
    e = table(spark, sf_dir, "events")
    lines = e.select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.col("event_type"), F.lit("] line "), F.col("event_id").cast("string")).alias("value"))
    parsed = S.parsed_log(lines)
    return parsed.groupBy("level", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max(F.regexp_extract("message", r"(\d+)$", 1).cast("long")).alias("last_line"))


@query("""SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, session, count(*) AS n FROM (
SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, session) GROUP BY user_id""")
def activity_sessions(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "30 minutes").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query()
def rate_limited(spark, sf_dir):
    """Events as requests: at most 3 accepted per user in any 600 seconds; rejected ones do not count."""
    return S.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", most=3, seconds=600.0)
