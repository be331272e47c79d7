"""What happens to documents, vectors, datasets and logs over time: access, ingestion, rebuild, renaming, upkeep.

Each operator takes the tables as they are and gives them, or the changes, as rows; problems are rows
too, so one bad document stops nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import strip
from ..scratch import written
from ..sources import versions


def readable(base_department: Column, role: Column, department: Column) -> Column:
    """May a user of that role and department read a base: super admins all, others their department's."""
    return F.coalesce((role == "super_admin") | ((base_department != "") & (base_department == department)), F.lit(False))


def manageable(base_department: Column, role: Column, department: Column) -> Column:
    """May they change it: super admins, and the department's own admins."""
    return F.coalesce((role == "super_admin") | ((role == "dept_admin") & (base_department != "") & (base_department == department)), F.lit(False))


def checked_pages(pages) -> list[tuple[int, int]]:
    """Ranges of pages (from, to), whole numbers from 1 with from <= to, one range at least; others are an error."""
    if not isinstance(pages, (list, tuple)) or not pages:
        raise ValueError(f"pages {pages!r} are no ranges")
    for r in pages:
        if not isinstance(r, (list, tuple)) or len(r) != 2 or any(type(x) is not int for x in r) or not 1 <= r[0] <= r[1]:
            raise ValueError(f"{r!r} is no range of pages")
    return [tuple(r) for r in pages]


def in_pages(rows: DataFrame, pages, page: str = "page") -> DataFrame:
    """Rows whose page lies in one of the ranges."""
    ranges = checked_pages(pages)
    return rows.where(F.greatest(F.lit(False), *(F.coalesce(F.col(page).between(a, b), F.lit(False)) for a, b in ranges)))


@dataclass(frozen=True)
class ChunkSettings:
    """Parameters of chunking within their bounds; others are an error."""

    chunk_size: int = 500
    overlap: int = 50
    level: int = 3
    parent_size: int = 2000
    pages: tuple[tuple[int, int], ...] | None = None

    def __post_init__(self):
        if self.pages is not None:
            checked_pages(self.pages)
        if not 50 <= self.chunk_size <= 20_000:
            raise ValueError(f"chunk_size {self.chunk_size} is not within 50 and 20000")
        if not 0 <= self.overlap < self.chunk_size:
            raise ValueError(f"overlap {self.overlap} is not below chunk_size {self.chunk_size}")
        if not 1 <= self.level <= 6:
            raise ValueError(f"level {self.level} is not within 1 and 6")
        if self.parent_size < self.chunk_size:
            raise ValueError(f"parent_size {self.parent_size} is below chunk_size {self.chunk_size}")


def renamed(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, new_name, problem (null if it may be done) of each asked name (doc_id, wanted).

    ``docs``: doc_id, kb_id, name. Names are trimmed, 1 to 255 signs; the file's extension stays: it is
    added where there is none, another one is a problem. A base holds a name once; of equal names asked
    for at once the smallest doc_id gets it.
    """
    suffix = lambda c: F.regexp_extract(c, r"[^.](\.[^.\s/]+)$", 1)
    joined = asked.select("doc_id", F.trim(F.coalesce("wanted", F.lit(""))).alias("wanted")).join(docs, "doc_id")
    old, new = suffix(F.col("name")), suffix(F.col("wanted"))
    named = joined.withColumns({"_other": (new != "") & (F.lower(new) != F.lower(old)), "new_name": F.when(new == "", F.concat("wanted", old)).otherwise(F.col("wanted"))})
    holders = docs.select("kb_id", F.col("name").alias("new_name"), F.col("doc_id").alias("_holder"))
    others = named.join(holders, ["kb_id", "new_name"]).where("_holder <> doc_id").select("doc_id").distinct().withColumn("_taken", F.lit(True))
    first = F.min("doc_id").over(Window.partitionBy("kb_id", "new_name"))
    checked = named.withColumn("_first", first).join(others, "doc_id", "left")
    problem = F.when(F.col("wanted") == "", "empty").when(F.length("wanted") > 255, "too long").when(F.col("_other"), "other extension").when(F.col("_taken") | (F.col("_first") < F.col("doc_id")), "taken")
    return checked.select("doc_id", "new_name", problem.alias("problem"))


def ingested(docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[Column], Column], dim: int, qa_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The vectors of ``docs`` (doc_id, kb_id, text) and a row for each document: doc_id, status, error, chunks.

    ``chunk`` gives doc_id, chunk_index, text, char_start, char_end; ``embed`` a vector of a text. A document
    without text or chunks, or with a chunk whose vector has not ``dim`` numbers, has failed and gives no vectors.
    With ``qa_only`` a document that is not made of questions and answers has failed as well.
    """
    from .chunking import question_statistics

    chunks = written(chunk(docs).withColumn("embedding", embed(F.col("text"))), "embedded")  # the model sees each text once
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).alias("bad"))
    state = docs.select("doc_id", "kb_id", F.coalesce(F.length(F.trim("text")), F.lit(0)).alias("n")).join(counted, "doc_id", "left")
    if qa_only:
        state = state.join(question_statistics(docs, "doc_id", "text").select("doc_id", "valid"), "doc_id", "left")
    error = F.when(F.col("n") == 0, "no text")
    error = error.when(~F.coalesce("valid", F.lit(False)), "no questions and answers") if qa_only else error
    error = error.when(F.col("chunks").isNull(), "no chunks").when(F.col("bad") > 0, "vectors of another size")
    told = state.withColumn("error", error)
    report = told.select("doc_id", F.when(F.col("error").isNull(), "ingested").otherwise("failed").alias("status"), "error", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    good = told.where("error IS NULL").select("doc_id", "kb_id")
    vectors = chunks.join(good, "doc_id").select("kb_id", F.concat_ws("_", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "text", "char_start", "char_end", "embedding")
    return vectors, report


def write_vectors(vectors: DataFrame, path: str) -> versions.Version:
    """Vectors as Parquet, a folder a base; the bases that ``vectors`` has are replaced all at once, others stay as they are.

    The new folders are a batch of their own, and a version of the small table of bases says which batch
    holds which base. A write that fails leaves all bases as they were; readers of old batches may finish.
    """
    spark, batch, before = vectors.sparkSession, uuid.uuid4().hex, versions.current(vectors.sparkSession, path)
    vectors.withColumn("kb_id", F.col("kb_id").cast("string")).write.partitionBy("kb_id").parquet(f"{path}/vectors/batch={batch}")
    new = _batches(spark, path).where(F.col("batch") == batch).select("kb_id", "batch").distinct()
    bases = new if before is None else _other(before.read(spark, "bases"), new).unionByName(new)
    return versions.publish(spark, path, {"bases": bases.coalesce(1)}, base=before)


def _other(bases: DataFrame, new: DataFrame) -> DataFrame:
    """The bases that ``new`` does not have; null is a base like others."""
    names = new.select(F.col("kb_id").alias("_new"))
    return bases.join(names, F.col("kb_id").eqNullSafe(F.col("_new")), "left_anti")


def _batches(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of all batches, old ones too."""
    found = spark.read.parquet(f"{path}/vectors").schema
    names = StructType([StructField(f.name, StringType() if f.name in ("kb_id", "batch") else f.dataType) for f in found])
    return spark.read.schema(names).parquet(f"{path}/vectors")  # else a base called 01 would be read as 1


def read_vectors(spark: SparkSession, path: str, kb_id: str | None = None) -> DataFrame:
    """All vectors, or a base's, of the current version: the folders of other bases and batches are not read."""
    at = versions.current(spark, path)
    if at is None:
        raise FileNotFoundError(f"no vectors were published in {path}")
    bases, rows = at.read(spark, "bases"), _batches(spark, path)
    if kb_id is not None:
        bases, rows = bases.where(F.col("kb_id") == kb_id), rows.where(F.col("kb_id") == kb_id)
    bases = bases.select(F.col("kb_id").alias("_kb"), F.col("batch").alias("_batch"))
    return rows.join(bases, F.col("kb_id").eqNullSafe(F.col("_kb")) & (F.col("batch") == F.col("_batch")), "left_semi").drop("batch")


def rebuilt(vectors: DataFrame, chunks: DataFrame, docs: DataFrame, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """All vectors of ingested ``docs`` (doc_id, status) made anew, and doc_id, done, error of each.

    The texts are those of the old vectors; a document that has none gets those of its ``chunks``
    (doc_id, chunk_index, text, context), and one without either is an error. Documents in the trash keep their vectors.
    """
    from ..functions.text import embedding_text

    wanted = docs.where("status = 'ingested'").select("doc_id")
    old = vectors.join(wanted, "doc_id", "left_semi").select("doc_id", "chunk_index", "text")
    missing = wanted.join(old.select("doc_id").distinct(), "doc_id", "left_anti")
    own = chunks.where("text <> ''").join(missing, "doc_id", "left_semi").select("doc_id", "chunk_index", embedding_text(F.col("context"), F.col("text")).alias("text"))
    texts = old.unionByName(own)
    done = texts.groupBy("doc_id").agg(F.count("*").alias("done"))
    report = wanted.join(done, "doc_id", "left").select("doc_id", F.coalesce("done", F.lit(0)).alias("done"), F.when(F.col("done").isNull(), "no text").alias("error"))
    return texts.withColumn("embedding", embed(F.col("text"))), report


def retained(rows: DataFrame, day: str, last_day: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days up to ``last_day``; on a table partitioned by ``day`` folders outside are not read."""
    return rows.where(F.col(day) > F.date_sub(last_day, days))


def without_sample(samples: DataFrame, index: int) -> DataFrame:
    """A dataset (dataset_id, idx and more) without the sample at ``index``; those after it move up."""
    kept = samples.where(F.col("idx") != index)
    return kept.withColumn("idx", F.when(F.col("idx") > index, F.col("idx") - 1).otherwise(F.col("idx")))


def with_sample(samples: DataFrame, more: DataFrame) -> DataFrame:
    """A dataset with samples (dataset_id and more, without idx; n orders them) at its end."""
    size = samples.groupBy("dataset_id").agg((F.max("idx") + 1).alias("_from"))
    place = F.row_number().over(Window.partitionBy("dataset_id").orderBy("n")) - 1
    added = more.withColumn("_at", place).join(size, "dataset_id", "left").withColumn("idx", F.coalesce("_from", F.lit(0)) + F.col("_at")).drop("_from", "_at", "n")
    return samples.unionByName(added)


def changed_sample(samples: DataFrame, index: int, values: dict[str, Column]) -> DataFrame:
    """A dataset whose sample at ``index`` has new values."""
    return samples.withColumns({c: F.when(F.col("idx") == index, v).otherwise(F.col(c)) for c, v in values.items()})


def migrated(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Bases (id, name, department_id and more) that the table has not yet: named ones, the first of a name, and no name that its department holds."""
    named = found.withColumn("name", F.trim("name")).where("name <> ''")
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy("department_id", "name").orderBy("id"))).where("_r = 1").drop("_r")
    return first.join(existing.select("department_id", "name"), ["department_id", "name"], "left_anti")


def samples_of_text(lines: DataFrame, most: int = 100) -> DataFrame:
    """Samples of lines (line, value) ``question TAB answer``: line, question, ground_truth, problem.

    Blank lines and comments (#) are left out; a line without a question or an answer is a problem (its first
    30 signs); of good ones the first ``most`` count, and what follows them is not read.
    """
    told = lines.withColumn("_t", strip(F.col("value"))).where("_t <> '' AND NOT startswith(_t, '#')")
    parts = F.split("value", "\t", 2)
    question, answer = strip(parts[0]), strip(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    good = (question != "") & (answer != "")
    rows = told.select("line", F.when(good, question).alias("question"), F.when(good, answer).alias("ground_truth"), F.when(~good, F.substring("_t", 1, 30)).alias("problem"))
    last = rows.where("problem IS NULL").orderBy("line").offset(most - 1).limit(1).agg(F.max("line").alias("_last"))  # one row
    return rows.join(F.broadcast(last)).where(F.col("_last").isNull() | (F.col("line") <= F.col("_last"))).drop("_last")


def seconds_left(seconds: Column, metrics: Column) -> Column:
    """The time the remaining metrics will take, from an array of what those done took; null before the first."""
    done = F.size(seconds)
    return F.when(done > 0, F.floor(F.aggregate(seconds, F.lit(0.0), lambda t, x: t + x) / done * (metrics - done)).cast("int"))


def may_extract(current_round: Column, last_round: Column, now: Column, last_at: Column, rounds: int = 5, minutes: int = 30) -> Column:
    """May a user's profile be extracted again: after ``rounds`` rounds or ``minutes`` minutes, or if it never was."""
    waited = (F.unix_timestamp(now) - F.unix_timestamp(last_at)) >= 60 * minutes
    last = F.coalesce(last_round, F.lit(0))
    return (current_round - last >= rounds) | F.coalesce(waited, F.lit(False)) | (last == 0)


def log_tail(lines: DataFrame, after: int, limit: int) -> DataFrame:
    """The last ``limit`` lines (line, value) behind ``after``, blank ones left out; the planner keeps no more than these."""
    return lines.where((F.col("line") > after) & (F.trim("value") != "")).orderBy(F.desc("line")).limit(limit)


def user_violations(users: DataFrame) -> DataFrame:
    """Rules that ``users`` (user_id, role, status, department_id) breaks: problem, department_id, n.

    A department has one admin at most, and one super admin at least is active.
    """
    admins = users.where("role = 'dept_admin'").groupBy("department_id").agg(F.count("*").alias("n")).where("n > 1")
    active = users.agg(F.count_if((F.col("role") == "super_admin") & (F.col("status") == "active")).alias("n")).where("n = 0")
    return admins.select(F.lit("several admins").alias("problem"), "department_id", "n").unionByName(active.select(F.lit("no active super admin").alias("problem"), F.lit(None).cast(users.schema["department_id"].dataType).alias("department_id"), "n"))
