"""Scans and sinks: text files of unknown encoding, datasets, logs, sessions, exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8, else GBK, else UTF-8 with replacement signs."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        for encoding in ("utf-8-sig", "gbk"):
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                pass
        return data.decode("utf-8", "replace")

    return content.map(one)


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A row per file: path, size, text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), decoded("content").alias("text"))


def _as_list(c: Column, kind: str) -> Column:
    """Contexts as an array: an array as it is, a JSON list parsed, other text as the only element."""
    if kind.startswith("array"):
        return c
    parsed = F.from_json(c, "array<string>")
    return F.when(F.trim(c).startswith("[") & parsed.isNotNull(), parsed).when(F.coalesce(c, F.lit("")) != "", F.array(c))


def dataset(spark: SparkSession, path: str, kind: str = "csv", samples_field: str | None = None) -> DataFrame:
    """Evaluation samples: question, answer, contexts (array), ground_truth. Only the question is required.

    ``kind``: csv, tsv or json (a list, objects one a line, or one object with a list for each column; with
    ``samples_field``, the list in that field). Other names of the columns: response, context, ground_truths
    (its first element). Empty fields and the text NaN are null.
    """
    if kind == "json":
        rows = spark.read.json(path, multiLine=True)
        if samples_field:
            rows = rows.select(F.inline(samples_field))
        elif dict(rows.dtypes).get("question", "").startswith("array"):
            rows = rows.select(F.inline(F.arrays_zip(*rows.columns)))
    else:
        rows = spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True, multiLine=True, escape='"')
    kinds = dict(rows.dtypes)
    missing = lambda c: F.when(F.lower(F.trim(c)).isin("", "nan"), None).otherwise(F.col(c))
    rows = rows.select(*((missing(c) if k == "string" else F.when(~F.isnan(c), F.col(c)) if k == "double" else F.col(c)).alias(c) for c, k in kinds.items()))
    if "question" not in kinds:
        raise ValueError("a dataset needs a column question")
    first = lambda names, null: next((F.col(n) for n in names if n in kinds), F.lit(None).cast(null))
    contexts = next((_as_list(F.col(n), kinds[n]) for n in ("contexts", "context") if n in kinds), F.lit(None).cast("array<string>"))
    truth = F.col("ground_truth") if "ground_truth" in kinds else F.get(_as_list(F.col("ground_truths"), kinds["ground_truths"]), F.lit(0)) if "ground_truths" in kinds else F.lit(None).cast("string")
    return rows.select("question", first(["answer", "response"], "string").alias("answer"), contexts.alias("contexts"), truth.alias("ground_truth"))


LOG_SCHEMA = "ts timestamp, kb_id string, query string, hits array<bigint>"


def append_by_day(entries: DataFrame, path: str, time: str = "ts") -> None:
    """Entries of a log as JSON lines, a folder a day."""
    entries.withColumn("dt", F.date_format(time, "yyyy-MM-dd")).write.mode("append").partitionBy("dt").json(path)


def append_log(entries: DataFrame, path: str) -> None:
    """Retrieval log entries, queries cut at 100 signs."""
    append_by_day(entries.select("ts", "kb_id", F.substring("query", 1, 100).alias("query"), "hits"), path)


def append_queries(entries: DataFrame, path: str) -> None:
    """Entries of the log of queries from outside (ts, config_id, session_id, query, answer): queries cut at 100, answers at 4,000 signs."""
    append_by_day(entries.select("ts", "config_id", "session_id", F.substring("query", 1, 100).alias("query"), F.substring("answer", 1, 4_000).alias("answer")), path)


def append_audit(entries: DataFrame, path: str) -> None:
    """Entries of the audit trail (ts, user_id, action, target_id, detail, ip, status): details cut at 1,000 signs."""
    append_by_day(entries.select("ts", "user_id", "action", "target_id", F.substring("detail", 1, 1_000).alias("detail"), "ip", "status"), path)


def read_log(spark: SparkSession, path: str, kb_id: str, last_day: str, days: int) -> DataFrame:
    """Entries of a base in the days up to ``last_day``; folders outside are not read, damaged lines are left out."""
    log = spark.read.schema(LOG_SCHEMA + ", dt string").json(path, mode="DROPMALFORMED")
    since = F.date_format(F.date_sub(F.lit(last_day).cast("date"), days - 1), "yyyy-MM-dd")
    return log.where((F.col("dt") >= since) & (F.col("dt") <= last_day) & (F.col("kb_id") == kb_id)).drop("dt")


def user_lines(lines: DataFrame, departments: DataFrame) -> DataFrame:
    """Users from lines ``user,name,department,role``: line, user, name, department, role, problem.

    Blank lines and those that begin with # are left out. ``lines``: line (number), value.
    """
    parts = F.split("value", ",")
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select("line", *(F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(("user", "name", "department", "role"))))
    first = rows.groupBy("user").agg(F.min("line").alias("first"))
    known = departments.select(F.col("name").alias("department"), F.lit(True).alias("known"))
    joined = rows.join(first, "user").join(known, "department", "left")
    problem = F.when(F.col("user") == "", "no user").when(~F.col("user").rlike(r"^\w{2,32}$"), "bad user").when(F.col("line") > F.col("first"), "repeated user").when(F.col("known").isNull() & (F.col("department") != ""), "unknown department")
    return joined.select("line", "user", "name", "department", "role", problem.alias("problem"))


def write_export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Results as JSON lines or as CSV with a header."""
    w = rows.write.mode("overwrite")
    w.json(path) if kind == "json" else w.option("header", True).csv(path)
