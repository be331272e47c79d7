"""Streams: daily statistics with a watermark, sessions, and folds with state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Retrievals and hits by base and day of a stream (ts, kb_id, hits); days close when the watermark passes them."""
    n = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "kb_id")
    return n.agg(F.count("*").alias("retrievals"), F.count_if(F.size("hits") > 0).alias("hit")).select(F.col("window.start").alias("day"), "kb_id", "retrievals", "hit")


def activity(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a key: events with gaps shorter than ``gap``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def rate_limited(requests: DataFrame, most: int = 20, seconds: float = 60.0) -> DataFrame:
    """key, id, accepted of a stream (key string, ts timestamp, id long); state: the accepted times of the last ``seconds``, ``most`` of them at most.

    Requests of a batch are taken in order of time; state of a key that is silent for ten windows goes.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for t in rows["ts"].map(pd.Timestamp.timestamp):
            passed = [p for p in passed if t - p < seconds]
            out.append(len(passed) < most)
            passed += [t] if out[-1] else []
        state.update((passed,))
        state.setTimeoutDuration(int(seconds * 10_000))
        yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "accepted": out})

    return requests.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("key").applyInPandasWithState(fold, "key string, id long, accepted boolean", "passed array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def merged_memory(old: list[tuple[str, float]], found: list[tuple[str, float]], keep: float = 0.7, fade: float = 0.9, least: float = 0.3) -> list[tuple[str, float]]:
    """A round of a profile memory: what is found again moves to keep * old + (1 - keep) * new, the rest fades, weak items go."""
    same = lambda text: "".join(text.split())
    new = {same(text): (text, c) for text, c in found}
    out = []
    for text, c in old:
        again = new.pop(same(text), None)
        c = keep * c + (1 - keep) * again[1] if again else (c or 0.5) * fade
        if c >= least:
            out.append((text, c))
    return out + [(text, c) for text, c in new.values() if c >= least]


def profile_memory(rounds: DataFrame) -> DataFrame:
    """The memory of each user after all rounds: user_id, content, confidence. ``rounds``: user_id string, round int, content string, confidence double.

    Rounds of a user follow each other, so this is a fold: Spark sorts the rows of a user and they pass
    through one worker as a stream, which holds a round and the user's memory and no more. Rows without a
    user or content are left out.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user = at = None
        memory: list[tuple[str, float]] = []
        found: list[tuple[str, float]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([user] * len(memory), pa.string()), pa.array([m[0] for m in memory], pa.string()), pa.array([m[1] for m in memory], pa.float64())], names=["user_id", "content", "confidence"])

        for batch in batches:
            for own, n, content, confidence in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (own, n) != (user, at):
                    memory = merged_memory(memory, found) if found else memory
                    found = []
                    if own != user:
                        if memory:
                            yield out()
                        memory = []
                    user, at = own, n
                found.append((content, confidence))
        memory = merged_memory(memory, found) if found else memory
        if memory:
            yield out()

    rows = rounds.where("content IS NOT NULL AND user_id IS NOT NULL").select(F.col("user_id").cast("string"), F.col("round").cast("long"), "content", F.col("confidence").cast("double"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "round", "content").mapInArrow(fold, "user_id string, content string, confidence double")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """New lines of log files as they come, parsed: ts, level, message. The checkpoint is the cursor."""
    from ..operators.stats import parsed_log

    return parsed_log(spark.readStream.schema("value string").text(path))


def write_daily(lines: DataFrame, path: str, checkpoint: str):
    """A stream of log lines (ts) as Parquet, a folder a day, so that days past their time go folder by folder."""
    dated = lines.withColumn("day", F.to_date("ts"))
    return dated.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
