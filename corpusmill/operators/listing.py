"""Filters, joins and pages over the metadata of bases, documents, users and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a status filter of the document list stands for.
STATUS_GROUPS = {"uploaded": ["uploaded", "parsed"], "unparsed": ["uploaded", "parsed"], "failed": ["failed", "pending_confirm"]}
UNASSIGNED = "__unassigned__"


def in_status(status: Column, wanted: str) -> Column:
    """True for documents of a status group; ``all`` takes every one."""
    return F.lit(True) if wanted == "all" else status.isin(STATUS_GROUPS.get(wanted, [wanted]))


def has_keyword(name: Column, keyword: str) -> Column:
    """Case-insensitive containment; an empty keyword takes all."""
    return F.lower(name).contains(keyword.lower()) if keyword else F.lit(True)


def in_department(department: Column, wanted: str | None) -> Column:
    """None takes all; ``__unassigned__`` takes those without a department."""
    return F.lit(True) if wanted is None else department.eqNullSafe(F.lit(None if wanted == UNASSIGNED else wanted))


def visible(owner: Column, allowed: list | str | None) -> Column:
    """Sessions a user may see: None or ``all`` takes all, a value its own, a list any of it and an empty list nothing."""
    if allowed is None or allowed == "all":
        return F.lit(True)
    if isinstance(allowed, (list, set, tuple)):
        return owner.isin(list(allowed)) if allowed else F.lit(False)
    return owner == allowed


def has_tags(tags: Column, wanted: list[str]) -> Column:
    """True where all wanted tags are among the tags."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0 if wanted else F.lit(True)


def clean_tags(tags: Column, most_chars: int = 20, most: int = 10) -> Column:
    """Trimmed, no empty or long ones, first occurrences only, at most ``most``."""
    trimmed = F.transform(tags, lambda t: F.trim(t))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda t: (t != "") & (F.length(t) <= most_chars))), 1, most)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of at most 200 rows in a total order; the planner keeps only what the page needs."""
    size = max(1, min(size, 200))
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def listed(docs: DataFrame, kb_id: str | None = None, trash: bool = False) -> DataFrame:
    """Documents (kb_id, deleted, created_at, deleted_at) of a base, or of all, newest first; with ``trash`` the deleted ones, last deleted first."""
    rows = docs.where(F.col("deleted") == trash)
    rows = rows if kb_id is None else rows.where(F.col("kb_id") == kb_id)
    return rows.orderBy(F.desc_nulls_last("deleted_at" if trash else "created_at"), "doc_id")


def sliced(samples: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Samples ``offset`` to ``offset + limit`` of each dataset by their idx (from 0), all that follow without a limit."""
    rows = samples.where(F.col("idx") >= offset)
    return rows if limit is None else rows.where(F.col("idx") < offset + limit)


def nested(rows: DataFrame, departments: DataFrame) -> DataFrame:
    """department_id, department_name, place, bases: the listed documents by department and base.

    ``rows``: department_id, kb_id, kb_name, doc_id, n (their order on the page listed, which is what bounds a group);
    ``departments``: department_id, department_name, created_at. Departments are in order of creation, ``place``
    from 1, unknown ones and documents without one at the end; those without documents are left out. Bases are in
    the order of their first document, documents in theirs.
    """
    docs = F.transform(F.array_sort(F.collect_list(F.struct("n", "doc_id"))), lambda x: x["doc_id"])
    bases = rows.groupBy("department_id", "kb_id").agg(F.min("n").alias("n"), F.min_by("kb_name", "n").alias("kb_name"), docs.alias("docs"))
    groups = bases.groupBy("department_id").agg(F.min("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("n", "kb_id", "kb_name", "docs"))), lambda b: b.dropFields("n")).alias("bases"))
    known = groups.join(departments.select("department_id", "department_name", "created_at"), "department_id", "left")
    order = Window.orderBy(F.asc_nulls_last("created_at"), F.col("department_id").isNull(), "n")  # a row a department
    return known.select("department_id", F.coalesce("department_name", F.lit("未分配部门")).alias("department_name"), F.row_number().over(order).alias("place"), "bases")


def paged(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page and, in each of its rows, total: how many rows there are in all."""
    return page(rows, order, number, size).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def in_scope(rows: DataFrame, role: str, department: str | None, column: str = "department_id") -> DataFrame:
    """What a role's statistics count: all for a super admin, the department's for others."""
    return rows if role == "super_admin" else rows.where(F.col(column) == F.lit(department))


def unknown_bases(configs: DataFrame, bases: DataFrame) -> DataFrame:
    """config_id, kb_id of bases that a configuration (config_id, kb_ids) names and that are not there."""
    return configs.select("config_id", F.explode("kb_ids").alias("kb_id")).distinct().join(bases.select("kb_id"), "kb_id", "left_anti").select("config_id", "kb_id")


def with_names(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name`` from a dimension table, or the key itself where the dimension has none (a deleted row keeps its id)."""
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), F.col(key).cast("string")))


def free_names(fresh: DataFrame, held: DataFrame, id_col: str) -> DataFrame:
    """``fresh`` (id, name) with names that neither ``held`` (name) nor another row has: the name, else the first free of name(1), name(2) and so on, in order of ids."""
    stem, suffix = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    rows = fresh.withColumns({"_stem": stem, "_suffix": suffix})
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_stem", "_suffix").orderBy(id_col)))
    base = F.regexp_extract("_held", r"^(.*?)(?:\((\d+)\))?$", 1)
    number = F.coalesce(F.regexp_extract("_held", r"\((\d+)\)$", 1).try_cast("long"), F.lit(0))
    taken = held.select(stem.alias("_held"), suffix.alias("_suffix")).select(base.alias("_stem"), "_suffix", number.cast("long").alias("_k")).distinct()
    used = taken.groupBy("_stem", "_suffix").agg(F.count("*").alias("_used"))
    room = rows.groupBy("_stem", "_suffix").agg(F.max("_n").alias("_most")).join(used, ["_stem", "_suffix"], "left")
    numbers = room.select("_stem", "_suffix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") + F.coalesce("_used", F.lit(0)))).alias("_k"))
    free = numbers.join(taken, ["_stem", "_suffix", "_k"], "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("_stem", "_suffix").orderBy("_k")))
    named = F.concat("_stem", F.when(F.col("_k") > 0, F.concat(F.lit("("), F.col("_k").cast("string"), F.lit(")"))).otherwise(""), "_suffix")
    return rows.join(free, ["_stem", "_suffix", "_n"]).withColumn("name", named).drop("_stem", "_suffix", "_n", "_k")
