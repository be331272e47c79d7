"""Queries of the knowledge graph and of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import stats as S
from ..sources.tables import table
from .registry import query

#: Mentions from the order lines: a part in an order is an entity in a document, its supplier the other end of a relation.
ENTITY_SQL = """(SELECT 'Part ' || (l_partkey % 500) AS name, CASE WHEN l_partkey % 2 = 0 THEN 'thing' ELSE 'place' END AS type, 'line ' || l_linenumber AS description, l_orderkey % 300 AS doc_id, l_linenumber AS chunk_index, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""


def entity_mentions(spark, sf_dir):
    part = (F.col("l_partkey") % 500).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(" Part "), part).alias("name"), F.when(F.col("l_partkey") % 2 == 0, "thing").otherwise("place").alias("type"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("description"),
        (F.col("l_orderkey") % 300).alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


#: Descriptions in order of first sight, each joined to those before unless they have it, cut at 200 signs.
FOLD_SQL = "list_reduce(list_prepend('', list_transform(list_sort(list({{'seq': seq, 'd': description}})), lambda x: x.d)), lambda a, x: substring(CASE WHEN a = '' THEN x WHEN contains(a, x) THEN a ELSE a || '；' || x END, 1, 200))"


@query(f"""WITH named AS (SELECT name, type, description, min(seq) AS seq FROM {ENTITY_SQL} GROUP BY ALL), told AS (SELECT name, type, {FOLD_SQL.format()} AS description FROM named GROUP BY name, type),
once AS (SELECT name, type, doc_id, chunk_index, min(seq) AS seq FROM {ENTITY_SQL} GROUP BY ALL), merged AS (SELECT name, type, count(*) AS n, min(seq) AS first_seen FROM once GROUP BY name, type)
SELECT 'e' || row_number() OVER (ORDER BY first_seen, name, type) AS id, name, type, n AS "count", first_seen, description FROM merged JOIN told USING (name, type)""")
def graph_entities(spark, sf_dir):
    return G.merged_entities(entity_mentions(spark, sf_dir)).select("id", "name", "type", "count", "first_seen", "description")


RELATION_SQL = "(SELECT DISTINCT 'n' || (l_partkey % 60) AS source, 'n' || (l_suppkey % 60) AS target, l_returnflag AS type, l_orderkey % 300 AS doc_id, l_linenumber AS chunk_index FROM lineitem)"
MERGED_SQL = f"(SELECT source, target, type, count(*)::DOUBLE AS weight FROM {RELATION_SQL} WHERE source <> target GROUP BY ALL)"


def relations(spark, sf_dir):
    node = lambda c: F.concat(F.lit("n"), (F.col(c) % 60).cast("string"))
    return G.merged_relations(table(spark, sf_dir, "lineitem").select(node("l_partkey").alias("source"), node("l_suppkey").alias("target"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") % 300).alias("doc_id"), F.col("l_linenumber").alias("chunk_index")))


@query(f"SELECT * FROM {MERGED_SQL}")
def graph_relations(spark, sf_dir):
    return relations(spark, sf_dir)


@query(f"SELECT DISTINCT a.asked, e.name, e.type FROM (SELECT DISTINCT name, type FROM {ENTITY_SQL}) e, (SELECT unnest(['part 12', 'part 4']) AS asked) a WHERE lower(e.name) = a.asked OR contains(lower(e.name), a.asked) OR contains(a.asked, lower(e.name))")
def graph_matches(spark, sf_dir):
    entities = G.merged_entities(entity_mentions(spark, sf_dir))
    names = spark.range(1).select(F.explode(F.array(F.lit("Part  12".replace("  ", " ")), F.lit("PART 4"))).alias("asked"))
    return G.matched(entities, names)


EDGES_SQL = "(SELECT DISTINCT p_partkey AS source, p_partkey * 7 % 1999 AS target FROM part WHERE p_partkey <> p_partkey * 7 % 1999)"


@query(f"""WITH e AS (SELECT source, target FROM {EDGES_SQL} UNION SELECT target, source FROM {EDGES_SQL}), h0 AS (SELECT unnest(generate_series(1, 20)) AS name), h1 AS (SELECT name FROM h0 UNION SELECT target FROM e WHERE source IN (SELECT name FROM h0)), h2 AS (SELECT name FROM h1 UNION SELECT target FROM e WHERE source IN (SELECT name FROM h1))
SELECT source, target FROM {EDGES_SQL} WHERE source IN (SELECT name FROM h2) AND target IN (SELECT name FROM h2)""")
def graph_neighbourhood(spark, sf_dir):
    """Two hops from twenty nodes, and the relations among what is reached."""
    edges = table(spark, sf_dir, "part").where("p_partkey <> p_partkey * 7 % 1999").select(F.col("p_partkey").alias("source"), F.expr("p_partkey * 7 % 1999").alias("target")).distinct()
    return G.induced(edges, G.neighbours(edges, spark.range(1, 21).select(F.col("id").alias("name")), hops=2))


@query(f"""WITH RECURSIVE e AS (SELECT source, target FROM {EDGES_SQL} UNION SELECT target, source FROM {EDGES_SQL}),
r AS (SELECT p_partkey AS start, p_partkey AS name, 0 AS hop FROM part WHERE p_partkey % 50 = 0 UNION SELECT r.start, e.target, r.hop + 1 FROM r JOIN e ON e.source = r.name WHERE r.hop < 4)
SELECT start, name, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY start, name""")
def graph_reach(spark, sf_dir):
    """What every part whose key is divisible by 50 reaches in four steps, and in how many."""
    edges = table(spark, sf_dir, "part").where("p_partkey <> p_partkey * 7 % 1999").select(F.col("p_partkey").alias("source"), F.expr("p_partkey * 7 % 1999").alias("target"))
    starts = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("start"))
    return G.reached_from(edges, starts, 4)


def verdicts(spark, sf_dir):
    """Three verdicts per document."""
    v = F.array(*((F.col("n_chars") / k).cast("int") % 2 for k in (1, 2, 4)))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), v.alias("v"), (F.col("n_chars") % 4).alias("tp"), (F.col("n_chars") % 3).alias("fp"), (F.col("n_chars") % 5).alias("fn"))


VERDICT_SQL = "(SELECT doc_id AS idx, n_chars % 2 AS v1, (n_chars // 2) % 2 AS v2, (n_chars // 4) % 2 AS v3, n_chars % 4 AS tp, n_chars % 3 AS fp, n_chars % 5 AS fn FROM documents)"
SCORES_SQL = f"""(SELECT idx, 'faithfulness' AS metric, (v1 + v2 + v3) / 3.0 AS score FROM {VERDICT_SQL}
UNION ALL SELECT idx, 'context_precision', CASE WHEN v1 + v2 + v3 = 0 THEN 0.0 ELSE (v1 * v1 / 1.0 + v2 * (v1 + v2) / 2.0 + v3 * (v1 + v2 + v3) / 3.0) / (v1 + v2 + v3) END FROM {VERDICT_SQL}
UNION ALL SELECT idx, 'answer_correctness', CASE WHEN idx % 10 = 0 THEN NULL WHEN tp = 0 THEN 0.0 ELSE tp / (tp + 0.5 * (fp + fn)) END FROM {VERDICT_SQL})"""


def scores(spark, sf_dir):
    c = F.col
    return E.long_scores(verdicts(spark, sf_dir), {"faithfulness": E.share_true(c("v")), "context_precision": E.average_precision(c("v")), "answer_correctness": F.when(c("idx") % 10 == 0, F.lit(float("nan"))).otherwise(E.f1(c("tp"), c("fp"), c("fn")))})


@query(f"SELECT idx, metric, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'no score' END AS error FROM {SCORES_SQL}")
def evaluation_scores(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"SELECT metric, round(avg(score), 4) AS mean, count(score) AS scored, count(*) AS samples FROM {SCORES_SQL} GROUP BY metric")
def evaluation_means(spark, sf_dir):
    return E.aggregated(scores(spark, sf_dir))


@query(f"SELECT idx, round(max(score) FILTER (metric = 'faithfulness'), 6) AS faithfulness, round(max(score) FILTER (metric = 'context_precision'), 6) AS context_precision FROM {SCORES_SQL} GROUP BY idx")
def evaluation_export(spark, sf_dir):
    wide = E.wide(scores(spark, sf_dir), ["faithfulness", "context_precision"])
    return wide.select("idx", *(F.round(m, 6).alias(m) for m in ("faithfulness", "context_precision")))


@query("SELECT o_orderkey AS task_id, o_custkey % 50 AS endpoint, CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS position FROM orders WHERE o_orderstatus = 'O'")
def evaluation_queue(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 50).alias("endpoint"), F.col("o_orderdate").alias("created_at"))
    return E.queue_positions(tasks).select("task_id", "endpoint", "position")


@query("SELECT user_id, event_id, event_type AS state, lag(event_type) OVER w AS before, coalesce((lag(event_type) OVER w, event_type) IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view')), false) AS legal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def state_transitions(spark, sf_dir):
    """Which changes of state are in the table of legal ones."""
    return S.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view")]).select("user_id", "event_id", "state", "before", "legal")


@query(f"""WITH first AS (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY seq, type) AS r FROM (SELECT name, type, min(seq) AS seq FROM {ENTITY_SQL} GROUP BY ALL)), t AS (SELECT name, type FROM first WHERE r = 1)
SELECT r.source, r.target, r.type, a.type AS source_type, b.type AS target_type FROM (SELECT DISTINCT 'Part ' || (l_partkey % 500) AS source, 'Part ' || (l_suppkey % 700) AS target, l_returnflag AS type FROM lineitem) r LEFT JOIN t a ON a.name = r.source LEFT JOIN t b ON b.name = r.target""")
def relation_ends(spark, sf_dir):
    """Relations whose ends are found by name: of a name's entities the one seen first, none for unknown names."""
    found = entity_mentions(spark, sf_dir).groupBy(F.trim("name").alias("name"), "type").agg(F.min("seq").alias("first_seen")).withColumn("id", F.col("type"))
    end = lambda c, k: F.concat(F.lit("Part "), (F.col(c) % k).cast("string"))
    told = table(spark, sf_dir, "lineitem").select(end("l_partkey", 500).alias("source"), end("l_suppkey", 700).alias("target"), F.col("l_returnflag").alias("type")).distinct()
    return G.with_ids(told, found).select("source", "target", "type", F.col("source_id").alias("source_type"), F.col("target_id").alias("target_type"))


@query(f"WITH n AS (SELECT source AS name FROM {RELATION_SQL} WHERE doc_id = 7 UNION SELECT target FROM {RELATION_SQL} WHERE doc_id = 7) SELECT source, target, type, weight FROM {MERGED_SQL} WHERE source IN (SELECT name FROM n) AND target IN (SELECT name FROM n)")
def graph_of_document(spark, sf_dir):
    """One document's names and the relations among them."""
    node = lambda c: F.concat(F.lit("n"), (F.col(c) % 60).cast("string"))
    m = table(spark, sf_dir, "lineitem").select(node("l_partkey").alias("source"), node("l_suppkey").alias("target"), (F.col("l_orderkey") % 300).alias("doc_id"))
    return G.of_document(relations(spark, sf_dir), m, 7)[1]


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 11 <> 0 THEN CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 2 END END::INTEGER AS entities, CASE WHEN d.doc_id % 11 <> 0 THEN CASE WHEN d.doc_id % 5 = 0 THEN 0 ELSE 1 END END::INTEGER AS relations,
CASE WHEN d.doc_id % 11 <> 0 THEN CASE WHEN d.doc_id % 5 = 0 THEN lang ELSE 'Doc' || ' ' || d.doc_id || ',' || lang END END AS names FROM documents d""")
def extracted_graph(spark, sf_dir):
    """Answers of a model, some without an object, checked: unknown types, repeated names and loose ends go."""
    doc = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    entity = lambda name, kind: F.struct(name.alias("name"), kind.alias("type"), F.lit("of {it}").alias("description"))
    relation = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    told = F.struct(
        F.array(entity(doc, F.when(F.col("doc_id") % 5 == 0, "other").otherwise("技术")), entity(F.col("lang"), F.lit("概念")), entity(F.col("lang"), F.lit("技术"))).alias("entities"),
        F.array(relation(doc, F.col("lang"), "属于"), relation(F.col("lang"), F.col("lang"), "属于"), relation(doc, F.lit("nobody"), "属于"), relation(doc, F.col("lang"), "likes")).alias("relations"),
    )
    answer = F.when(F.col("doc_id") % 11 == 0, F.lit("I found {nothing}")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), F.to_json(told), F.lit("\n```"))).otherwise(F.concat(F.lit("So: "), F.to_json(told), F.lit(" {end}")))
    found = G.extracted(table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer")), ["doc_id"], "answer")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return found.select("doc_id", size("entities").alias("entities"), size("relations").alias("relations"), F.array_join("entities.name", ",").alias("names"))
