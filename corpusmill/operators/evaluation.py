"""Evaluation: scores per sample and metric, their aggregation and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escaped_html
from ..functions.vectors import cosine

# The metrics by name, and those that need embeddings.
METRICS = ["answer_correctness", "answer_relevancy", "context_precision", "context_recall", "faithfulness", "semantic_similarity"]
NEED_EMBEDDINGS = ["answer_relevancy", "semantic_similarity"]


def resolved(names: list[str], embeddings: bool = True) -> tuple[list[str], list[str]]:
    """The metrics to run, each once, and the unknown names; without embeddings those that need them are left out."""
    known = [n for n in dict.fromkeys(names) if n in METRICS]
    return [n for n in known if embeddings or n not in NEED_EMBEDDINGS], [n for n in dict.fromkeys(names) if n not in METRICS]


def share_true(verdicts: Column) -> Column:
    """Faithfulness and recall: the share of verdicts that are 1; null for none."""
    return F.when(F.size(verdicts) > 0, F.aggregate(verdicts, F.lit(0.0), lambda t, v: t + v) / F.size(verdicts))


def average_precision(verdicts: Column) -> Column:
    """Context precision: mean of precision at each relevant position; 0 if none is relevant."""
    upto = lambda i: F.aggregate(F.slice(verdicts, 1, i + 1), F.lit(0.0), lambda t, v: t + v) / (i + 1)
    hits = F.aggregate(verdicts, F.lit(0.0), lambda t, v: t + v)
    total = F.aggregate(F.transform(verdicts, lambda v, i: v * upto(i)), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(verdicts) > 0, F.when(hits > 0, total / hits).otherwise(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Answer correctness: tp / (tp + (fp + fn) / 2); 0 without true positives."""
    return F.when(tp > 0, tp / (tp + 0.5 * (fp + fn))).otherwise(0.0)


def answer_relevancy(question: Column, asked: Column, evasive: Column) -> Column:
    """Mean cosine of the question's vector and those of questions made from the answer; 0 if all answers evade (1), null for none."""
    each = F.aggregate(F.transform(asked, lambda v: cosine(question, v)), F.lit(0.0), lambda t, x: t + x) / F.size(asked)
    return F.when(F.size(asked) > 0, F.when(F.forall(evasive, lambda e: e == 1), 0.0).otherwise(each))


def html_reports(scores: DataFrame, key: str) -> DataFrame:
    """A page for each ``key`` with its scores (idx, metric, score) as a table, a row a sample: key, html. A task's samples bound a page."""
    number = F.when(F.col("score").isNull(), "-").otherwise(F.format_string("%.4f", "score"))
    cells = F.array_sort(F.collect_list(F.struct("metric", number.alias("v"))))
    line = F.concat(F.lit("<tr><td>"), F.col("idx").cast("string"), F.lit("</td>"), F.array_join(F.transform("c", lambda x: F.concat(F.lit("<td>"), escaped_html(x["metric"]), F.lit(": "), x["v"], F.lit("</td>"))), ""), F.lit("</tr>"))
    rows = scores.groupBy(key, "idx").agg(cells.alias("c")).select(key, F.struct("idx", line.alias("line")).alias("r"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("l"))
    return listed.select(key, F.concat(F.lit("<table>"), F.array_join(F.col("l.line"), ""), F.lit("</table>")).alias("html"))


def long_scores(samples: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """A row per sample and metric: idx, metric, score, error. NaN becomes null with a reason."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c.cast("double").alias("raw")) for m, c in scores.items())))
    rows = samples.select("idx", each.alias("s")).select("idx", "s.metric", "s.raw")
    bad = F.col("raw").isNull() | F.isnan("raw")
    return rows.select("idx", "metric", F.when(~bad, F.col("raw")).alias("score"), F.when(bad, F.lit("no score")).alias("error"))


def aggregated(scores: DataFrame) -> DataFrame:
    """Mean of each metric over samples with a score (4 digits); metrics without any are left out."""
    return scores.groupBy("metric").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("score").alias("scored"), F.count("*").alias("samples")).where("scored > 0")


def wide(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """A row per sample with a column per metric, as the CSV export has it."""
    return scores.groupBy("idx").pivot("metric", metrics).agg(F.first("score", ignorenulls=True))


def queue_positions(tasks: DataFrame) -> DataFrame:
    """One task of an endpoint runs, the others wait in order of creation: adds position, 0 for the running one."""
    order = Window.partitionBy("endpoint").orderBy("created_at", "task_id")
    return tasks.withColumn("position", (F.row_number().over(order) - 1).cast("int"))
