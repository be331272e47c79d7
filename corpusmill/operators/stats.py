"""Statistics, sampling and ordered folds over logs and conversations."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(log: DataFrame) -> DataFrame:
    """Per base: retrievals, average number of hits (2 digits), retrievals without hits."""
    return log.groupBy("kb_id").agg(F.count("*").alias("retrievals"), F.round(F.avg(F.size("hits")), 2).alias("avg_hits"), F.count_if(F.size("hits") == 0).alias("zero_hits"))


def hit_ranking(log: DataFrame, top: int) -> DataFrame:
    """The documents hit most often, ties by first occurrence."""
    hits = log.select(F.explode("hits").alias("doc_id"), "seq").groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("seq").alias("first_seen"))
    return hits.orderBy(F.desc("hits"), "first_seen", "doc_id").limit(top).select("doc_id", "hits")


def daily(log: DataFrame, days: int) -> DataFrame:
    """A row for each of the last ``days`` days up to the newest entry, also for days without any: day, retrievals, hit_rate (4 digits)."""
    counted = log.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("retrievals"), F.count_if(F.size("hits") > 0).alias("hit"))
    last = counted.agg(F.max("d").alias("last"))
    every = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("d"))
    return every.join(counted, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("retrievals", F.lit(0)).alias("retrievals"), F.coalesce(F.round(F.col("hit") / F.col("retrievals"), 4), F.lit(0.0)).alias("hit_rate"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that has no ties; each task keeps one row a key before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """User turns followed by an assistant's, blank questions left out; of equal questions the newest conversation's."""
    talk = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("conv_id", "turn", "role", F.trim("text").alias("question"), F.lead("role").over(talk).alias("next_role"), F.lead("text").over(talk).alias("answer"))
    pairs = pairs.where("role = 'user' AND next_role = 'assistant' AND question <> ''")
    return latest(pairs, ["question"], [F.desc("conv_id"), F.desc("turn")]).select("conv_id", "turn", "question", "answer")


def parsed_log(lines: DataFrame) -> DataFrame:
    """ts, level and message of lines such as ``2024-01-01 00:00:00 [INFO] text``; other lines are left out."""
    pattern = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) \[(\w+)\] (.*)$"
    parts = [F.regexp_extract("value", pattern, i) for i in (1, 2, 3)]
    return lines.where(F.col("value").rlike(pattern)).select(F.to_timestamp(parts[0]).alias("ts"), parts[1].alias("level"), parts[2].alias("message"))


def sessions(events: DataFrame, key: str, ts: str, tie: str, gap: str) -> DataFrame:
    """Islands of events of a key with gaps of at most ``gap``: key, session, n."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    fresh = F.when(F.lag(ts).over(order) >= F.col(ts) - F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    numbered = events.select(key, ts, tie, fresh.alias("fresh")).withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n"))


def rate_limit(requests: DataFrame, key: str, ts: str, tie: str, most: int, seconds: float) -> DataFrame:
    """key, tie, accepted: a request passes if fewer than ``most`` passed in the ``seconds`` before it.

    Whether a request counts depends on those before it, so this is a fold: the rows of a key are
    sorted by Spark and pass through one worker as a stream, which holds ``most`` times and no more.
    A null key or time is never accepted, and a null key meets no fold.
    """
    refused = requests.where(F.col(key).isNull()).select(F.col(key), F.col(tie), F.lit(False).alias("accepted"))
    requests = requests.where(F.col(key).isNotNull())
    rows = requests.select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("t"), F.col(tie).alias("i"))
    kinds = [f.dataType.simpleString() for f in rows.schema]

    def fold(batches):
        now, passed = object(), deque()
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist(), strict=True):
                if k != now:
                    now, passed = k, deque()
                while passed and t is not None and t - passed[0] >= seconds * 1e6:
                    passed.popleft()
                ok = k is not None and t is not None and len(passed) < most
                if ok:
                    passed.append(t)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.bool_())], names=["k", "i", "accepted"])

    return rows.repartition("k").sortWithinPartitions("k", "t", "i").mapInArrow(fold, f"k {kinds[0]}, i {kinds[2]}, accepted boolean").select(F.col("k").alias(key), F.col("i").alias(tie), "accepted").unionByName(refused)


def transitions(rows: DataFrame, key: str, state: str, order: list[str], legal: list[tuple[str, str]]) -> DataFrame:
    """Adds state, before (the key's state before, null for the first) and legal: whether the change is in the table."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    marked = rows.withColumns({"state": F.col(state), "before": before})
    pairs = F.array(*(F.lit(f"{a}\x00{b}") for a, b in legal))
    return marked.withColumn("legal", F.coalesce(F.array_contains(pairs, F.concat_ws("\x00", "before", "state")) & F.col("before").isNotNull(), F.lit(False)))
