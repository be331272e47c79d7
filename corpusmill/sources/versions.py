"""Versions of a set of tables, swapped in one step.

A version's tables are written to a folder that nobody reads yet. It becomes the current one by a row that
is appended to the log: a single small file, which Spark's committer moves into place at once or not at
all. So a reader sees all tables of the old version or all of the new one, whatever fails or is killed in
between, and who began to read an old version may finish. Everything is Spark reads and writes, so any
path that Spark can write will do. Of two writers that add the same version, the one whose row comes first
by its token has won; the other is told so and its tables are never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "version long, token string, tables array<struct<name: string, schema: string>>, note string, at timestamp, forgotten boolean"


class LostRace(RuntimeError):
    """Another writer has added this version first."""


@dataclass(frozen=True)
class Version:
    """A version that can be read; its tables by name with their schemas as JSON."""

    number: int
    token: str
    tables: tuple[tuple[str, str], ...]
    root: str

    def path(self, name: str) -> str:
        """The folder of one of its tables."""
        if name not in dict(self.tables):
            raise KeyError(f"version {self.number} has no table {name}, but {', '.join(dict(self.tables))}")
        return f"{self.root}/data/{self.number}-{self.token}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """One of its tables."""
        path = self.path(name)
        return spark.read.schema(StructType.fromJson(json.loads(dict(self.tables)[name]))).parquet(path)


def _log(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the log; none where there is no log yet."""
    try:
        return spark.read.schema(LOG).parquet(f"{root}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def history(spark: SparkSession, root: str) -> DataFrame:
    """version, token, tables, note, at of each version that can be read, one row each."""
    log = _log(spark, root)
    added = log.where("NOT forgotten").groupBy("version").agg(F.min(F.struct("token", "tables", "note", "at")).alias("v")).select("version", "v.*")
    return added.join(log.where("forgotten").select("version", "token"), ["version", "token"], "left_anti")


def current(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The newest version, or the one of that number; None where there is none."""
    rows = history(spark, root)
    row = (rows if number is None else rows.where(F.col("version") == number)).orderBy(F.desc("version")).first()
    return row and Version(row.version, row.token, tuple(map(tuple, row.tables)), root.rstrip("/"))


def _append(spark: SparkSession, root: str, version: Version, note: str | None, forgotten: bool) -> None:
    row = spark.createDataFrame([(version.number, version.token, list(version.tables), note, forgotten)], LOG.replace(" at timestamp,", ""))
    row.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/log")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], note: str | None = None, partition_by: dict[str, list[str]] | None = None, base: Version | None = None) -> Version:
    """Writes all ``tables`` and makes them the current version. Tables may be made from the version they replace.

    ``partition_by``: columns whose values get folders of their own, by table. ``base``: the version that the
    tables were made from; if another one has become current since, that is an error and nothing is swapped.
    """
    root = root.rstrip("/")
    before = current(spark, root)
    if base and (before is None or before.token != base.token):
        raise LostRace(f"version {base.number} of {root} is no longer the current one")
    last = _log(spark, root).agg(F.max("version")).first()[0]
    version = Version((last or 0) + 1, uuid.uuid4().hex, tuple((name, rows.schema.json()) for name, rows in tables.items()), root)
    for name, rows in tables.items():
        rows.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(version.path(name))
    _append(spark, root, version, note, False)
    if current(spark, root, version.number) != version:
        raise LostRace(f"version {version.number} of {root} was added by another writer")
    return version


def forget(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Empties the tables of all but the newest ``keep`` versions, which can then not be read any more; their numbers."""
    old = [Version(r.version, r.token, tuple(map(tuple, r.tables)), root.rstrip("/")) for r in history(spark, root).orderBy(F.desc("version")).collect()[max(1, keep) :]]
    for version in old:
        _append(spark, root, version, None, True)  # first out of sight, then gone
        for name, _ in version.tables:
            spark.createDataFrame([], version.read(spark, name).schema).write.mode("overwrite").parquet(version.path(name))
    return sorted(v.number for v in old)
