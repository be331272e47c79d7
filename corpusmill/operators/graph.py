"""A small knowledge graph: merging extracted entities and relations, matching names, expanding neighbours.

Entities and relations are DataFrames; a hop is two semi joins, so no graph engine is needed.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import versions
from ..functions.text import json_object, normalized_name, strip
from ..scratch import written


def merged_entities(found: DataFrame, most_chars: int = 200) -> DataFrame:
    """Entities by name and type: id (e1, e2, ... in order of first sight), count of distinct (doc, chunk), first_seen, description.

    ``found``: name, type, description, doc_id, chunk_index, seq. The description is that of the
    mentions folded in order of ``seq``, cut at ``most_chars``.
    """
    named = found.withColumn("name", normalized_name(F.col("name"))).where("name <> ''")
    once = named.groupBy("name", "type", "doc_id", "chunk_index").agg(F.min("seq").alias("seq"))
    merged = once.groupBy("name", "type").agg(F.count("*").alias("count"), F.min("seq").alias("first_seen"))
    return numbered(_described(merged, named, ["name", "type"], most_chars), "e")


def _described(merged: DataFrame, found: DataFrame, keys: list[str], most_chars: int) -> DataFrame:
    """``merged`` with the descriptions of ``found`` by key: each that the text so far does not contain is added after a separator.

    Only the first descriptions of a key can count: those added lengthen the text by two signs at
    least, and those contained in it are substrings of ``most_chars`` signs.
    """
    most = most_chars + most_chars * (most_chars + 1) // 2
    # a description longer than the cut is in no text, and what follows its next sign is never seen
    cut = found.withColumn("description", F.substring("description", 1, most_chars + 1)).where("description <> ''")
    each = cut.groupBy(*keys, "description").agg(F.min("seq").alias("seq"))
    each = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "description"))).where(F.col("_r") <= most)
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "description"))).alias("_all"))
    joined = lambda old, x: F.when(old == "", x["description"]).when(F.contains(old, x["description"]), old).otherwise(F.concat(old, F.lit("；"), x["description"]))
    folded = listed.select(*(F.col(k).alias(f"_{k}") for k in keys), F.aggregate("_all", F.lit(""), lambda old, x: F.substring(joined(old, x), 1, most_chars)).alias("description"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return merged.join(folded, same, "left").drop(*(f"_{k}" for k in keys)).withColumn("description", F.coalesce("description", F.lit("")))


def bound_index(table: Column, value: Column, n: int) -> Column:
    """How many of the ``n`` rising bounds of ``table`` are not above ``value``: a step for each bit of n."""
    at = F.lit(0)
    for bit in reversed(range(n.bit_length())):
        step = at + F.lit(1 << bit)
        at = F.when((step <= n) & (F.get(table, step - 1) <= value), step).otherwise(at)
    return at


def numbered(rows: DataFrame, prefix: str, range_rows: int = 20_000, most_ranges: int = 10_000) -> DataFrame:
    """Adds id: prefix and a dense number in order of ``first_seen``, without gathering the rows in one task.

    Rows are written once and dealt to ranges of first_seen at percentiles, about ``range_rows`` rows each;
    a number is the rank in its range plus the size of the ranges before.
    """
    rows = written(rows, "numbered")
    ranges = max(1, min(most_ranges, rows.count() // range_rows))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = (rows.agg(F.percentile_approx("first_seen", F.lit(cuts), max(10_000, 10 * ranges))).first()[0] or []) if cuts else []
    table = F.split(F.lit(",".join(map(str, sorted(set(bounds))))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    at = bound_index(table, F.col("first_seen"), len(set(bounds)))
    dealt = rows.withColumn("_range", at)
    before = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # at most ``most_ranges`` rows
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("first_seen", "name", "type"))
    return dealt.withColumn("_rank", rank).join(F.broadcast(before), "_range").withColumn("id", F.concat(F.lit(prefix), (F.col("_rank") + F.col("_before")).cast("string"))).drop("_range", "_rank", "_before")


def merged_relations(found: DataFrame, most_chars: int = 200) -> DataFrame:
    """Relations by source, target and type: weight = number of distinct (doc, chunk). Loops are left out.

    Where ``found`` has description and seq, description is folded as that of entities.
    """
    named = found.withColumns({"source": normalized_name(F.col("source")), "target": normalized_name(F.col("target"))})
    named = named.where("source <> target AND source <> '' AND target <> ''")
    once = named.select("source", "target", "type", "doc_id", "chunk_index").distinct()
    merged = once.groupBy("source", "target", "type").agg(F.count("*").cast("double").alias("weight"))
    return _described(merged, named, ["source", "target", "type"], most_chars) if {"description", "seq"} <= set(found.columns) else merged


def _grams(c: Column, size: int) -> Column:
    """The distinct runs of ``size`` signs of a text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(c, i, F.lit(size)))
    return F.when(F.length(c) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def matched(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities whose name equals an asked name, contains it or is contained in it: asked, name, type.

    A contained name has two signs at least. One name can only contain another if it has all its runs of
    three signs (of two, where the other is that short), so the other's rarest one finds it: both ways are
    joins on that run, and what they find is checked. No name meets all others.
    """
    asked = names.select(F.lower(normalized_name(F.col("asked"))).alias("asked")).where("asked <> ''").distinct()
    own = entities.select("name").distinct().withColumn("n", F.lower("name"))
    runs = lambda c: F.explode(F.concat(_grams(c, 3), _grams(c, 2)))
    of_own = written(own.select("name", "n", runs(F.col("n")).alias("gram")), "grams")
    often = written(of_own.groupBy("gram").agg(F.count("*").alias("df")), "gram-counts")
    of_asked = asked.select("asked", runs(F.col("asked")).alias("gram"))
    # the rarest run of those a name must be looked up by; a run that no entity has rules the name out
    wide = lambda c: F.length("gram") == F.least(F.length(c), F.lit(3))
    rarest = F.min_by("gram", F.struct("df", "gram"))
    by_own = of_own.where(wide("n")).join(often, "gram").groupBy("name", "n").agg(rarest.alias("gram"))
    by_asked = of_asked.where(wide("asked")).join(often, "gram", "left").groupBy("asked").agg(rarest.alias("gram"), F.count_if(F.col("df").isNull()).alias("unknown")).where("unknown = 0")
    inside = by_own.join(of_asked, "gram").where(F.contains("asked", "n")).select("asked", "name")
    around = of_own.join(by_asked, "gram").where(F.contains("n", "asked")).select("asked", "name")
    same = own.join(asked, F.col("n") == F.col("asked")).select("asked", "name")
    return entities.select("name", "type").join(inside.unionByName(around).unionByName(same).distinct(), "name").select("asked", "name", "type")


# The types that extraction may give.
ENTITY_TYPES = ["人物", "机构", "技术", "概念", "事件", "成果"]
RELATION_TYPES = ["提出", "开发", "发明", "启动", "导致", "影响", "属于", "相关"]
EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,type:string,description:string>>"


def extracted(answers: DataFrame, keys: list[str], answer_col: str, entity_types: list[str] = ENTITY_TYPES, relation_types: list[str] = RELATION_TYPES, most_chars: int = 200) -> DataFrame:
    """Checked answers of a model: ``keys``, entities and relations (arrays); both null where the answer has no such object.

    Names are normalized; an entity needs a name and a known type, the first of a name counts; a relation
    needs a known type and two different ends among the entities. Descriptions are cut at ``most_chars``.
    """
    told = answers.select(*keys, json_object(F.col(answer_col), EXTRACTION).alias("o"))
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    entity = lambda e: F.struct(F.coalesce(normalized_name(e["name"]), F.lit("")).alias("name"), text(e["type"]).alias("type"), F.substring(text(e["description"]), 1, most_chars).alias("description"))
    relation = lambda r: F.struct(F.coalesce(normalized_name(r["source"]), F.lit("")).alias("source"), F.coalesce(normalized_name(r["target"]), F.lit("")).alias("target"), text(r["type"]).alias("type"), F.substring(text(r["description"]), 1, most_chars).alias("description"))
    read = told.where("o.entities IS NOT NULL AND o.relations IS NOT NULL").select(*keys, F.transform("o.entities", entity).alias("e"), F.transform("o.relations", relation).alias("r"))
    known = read.withColumn("e", F.filter("e", lambda e: (e["name"] != "") & e["type"].isin(entity_types)))
    first = known.withColumn("e", F.filter("e", lambda e, i: F.array_position(F.col("e.name"), e["name"]) == i + 1))
    ends = lambda r: F.array_contains(F.col("e.name"), r["source"]) & F.array_contains(F.col("e.name"), r["target"])
    valid = first.select(*keys, F.col("e").alias("entities"), F.filter("r", lambda r: r["type"].isin(relation_types) & (r["source"] != r["target"]) & ends(r)).alias("relations"))
    return answers.select(*keys).join(valid, keys, "left")


def with_ids(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds source_id and target_id: of the entities of a name the one seen first, null where there is none."""
    order = Window.partitionBy("name").orderBy("first_seen", "type")
    first = entities.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("name", "id")
    out = relations
    for end in ("source", "target"):
        out = out.join(first.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id")), end, "left")
    return out


def of_document(relations: DataFrame, mentions: DataFrame, doc_id) -> tuple[DataFrame, DataFrame]:
    """A document's part of the graph: the names that ``mentions`` (source, target, doc_id) has of it, and the relations among them."""
    names = mentions.where(F.col("doc_id") == doc_id).select(F.explode(F.array("source", "target")).alias("name")).distinct()
    return names, induced(relations, names)


def context_lines(entities: DataFrame, relations: DataFrame, key: str, most_entities: int = 30, most_relations: int = 40, most_chars: int = 60) -> DataFrame:
    """The text that a prompt gets of each ``key``'s entities (name, type, description, count, n) and relations
    (source, type, target, description, n): key, context. The first of each by ``n``, descriptions cut."""
    bare = F.replace(strip(F.coalesce("description", F.lit(""))), F.lit("\n"), F.lit(" "))
    cut = F.when(F.length(bare) > most_chars, F.concat(F.substring(bare, 1, most_chars), F.lit("…"))).otherwise(bare)
    told = [
        (0, "【知识图谱实体】", entities, most_entities, F.concat("name", F.lit("("), "type", F.lit("|"), cut, F.lit("|"), F.col("count").cast("string"), F.lit(")"))),
        (1, "【知识图谱关系】", relations, most_relations, F.concat_ws("|", "source", "type", "target", cut)),
    ]
    rows = None
    for part, title, frame, most, line in told:
        top = frame.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("n"))).where(F.col("_r") <= most)
        lines = top.select(key, F.lit(part).alias("part"), F.col("_r").alias("r"), line.alias("line"))
        lines = lines.unionByName(lines.select(key, "part", F.lit(0).alias("r"), F.lit(title).alias("line")).distinct())
        rows = lines if rows is None else rows.unionByName(lines)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "r", "line"))).alias("l")).select(key, F.array_join(F.col("l.line"), "\n").alias("context"))


def shown_network(relations: DataFrame, counts: DataFrame, start: DataFrame, hops: int = 2, most: int = 200) -> DataFrame:
    """Relations to draw around ``start``: ``hops`` steps; one step if that reaches over ``most`` names; of too many still the
    ``most`` with the highest count (``counts``: name, count; the start's come first, ties by name)."""
    reached = neighbours(relations, start, hops)
    if hops > 1 and reached.limit(most + 1).count() > most:
        reached = neighbours(relations, start, 1)
    own = start.select("name").distinct().withColumn("_own", F.lit(1))
    ranked = reached.join(counts, "name", "left").join(own, "name", "left").orderBy(F.desc_nulls_last("_own"), F.desc_nulls_last("count"), "name").limit(most)
    return induced(relations, ranked)


def write_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Saves a base's graph as a version of two tables: readers see both new ones or both old ones."""
    versions.publish(entities.sparkSession, path, {"entities": entities, "relations": relations})


def read_graph(spark: SparkSession, path: str, entities: str, relations: str) -> tuple[DataFrame, DataFrame]:
    """A saved graph by the schemas of its tables; empty tables where there is none or it is damaged."""
    try:
        if at := versions.current(spark, path):
            return at.read(spark, "entities"), at.read(spark, "relations")
    except (PySparkException, Py4JJavaError):
        pass
    return spark.createDataFrame([], entities), spark.createDataFrame([], relations)


def reached_from(relations: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, name, hop of all names that each of ``starts`` (start) reaches, in as few steps as it takes, ``hops`` at most.

    Only names met for the first time go on, so a step reads what the one before has found and no more; it
    ends early where nothing new is met.
    """
    both = relations.select(F.col("source").alias("name"), F.col("target").alias("next")).unionByName(relations.select(F.col("target").alias("name"), F.col("source").alias("next"))).distinct()
    front = written(starts.where("start IS NOT NULL").select("start", F.col("start").alias("name"), F.lit(0).alias("hop")).distinct(), "front")
    known = front
    for hop in range(1, hops + 1):
        met = front.join(both, "name").select("start", F.col("next").alias("name")).distinct()
        front = written(met.join(known, ["start", "name"], "left_anti").withColumn("hop", F.lit(hop)), "front")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def neighbours(relations: DataFrame, start: DataFrame, hops: int = 1) -> DataFrame:
    """Names reached from ``start`` (name) in at most ``hops`` steps, those of the start included."""
    both = relations.select(F.col("source").alias("name"), F.col("target").alias("next")).unionByName(relations.select(F.col("target").alias("name"), F.col("source").alias("next")))
    front = start.select("name").distinct()
    known = front
    for hop in range(hops):
        met = both.join(front, "name", "left_semi").select(F.col("next").alias("name")).distinct().join(known, "name", "left_anti")
        front = met if hop == hops - 1 else written(met, "front")
        known = known.unionByName(front)
    return known


def induced(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with both ends among ``names``."""
    ends = names.select("name")
    return relations.join(ends.withColumnRenamed("name", "source"), "source", "left_semi").join(ends.withColumnRenamed("name", "target"), "target", "left_semi")
