"""Queries around retrieval: fallbacks, contexts, index status, graph upkeep, exports, lifecycle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import context as X
from ..operators.chunking import pieces_of
from ..sources.tables import table
from .registry import query

#: A ranking: the events of each user in order.
HITS_SQL = "(SELECT user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events)"


def hits(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), rank.alias("rank"))


@query(f"""WITH h AS (SELECT *, CASE WHEN (chunk_id + query_id) % (1 + query_id % 4) <> 1 THEN (chunk_id % 5) / 5.0 END AS s FROM {HITS_SQL}),
m AS (SELECT *, coalesce(2 * count(s) OVER q >= count(*) OVER q AND max(s) OVER q > 0, false) AS used, coalesce(s, min(s) OVER q) AS filled FROM h WINDOW q AS (PARTITION BY query_id))
SELECT query_id, chunk_id, CASE WHEN used THEN filled END AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN used THEN filled ELSE 0 END DESC, rank) AS rank FROM m""")
def rerank_fallback(spark, sf_dir):
    h = hits(spark, sf_dir)
    scores = h.where("(chunk_id + query_id) % (1 + query_id % 4) <> 1").select("query_id", "chunk_id", (F.col("chunk_id") % 5 / 5.0).alias("rerank_score"))
    return X.usable_rerank(h, scores)


@query("SELECT conv_id AS query_id, string_agg(CASE WHEN turn % 2 = 0 THEN 'parent ' || text ELSE text END, '|' ORDER BY turn) AS contexts FROM conversations WHERE turn < 5 GROUP BY conv_id")
def context_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("chunk_id", F.concat_ws("-", "conv_id", "turn"))
    ranked = c.select(F.col("conv_id").alias("query_id"), "chunk_id", (F.col("turn") + 1).alias("rank"))
    chunks = c.select("chunk_id", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("parent "), "text")).alias("parent_text"), "text")
    return X.contexts(ranked, chunks, 5).select("query_id", F.array_join("contexts", "|").alias("contexts"))


@query("SELECT label, count(*) AS vectors, min(len(embedding))::INTEGER AS dim, CASE WHEN min(len(embedding)) <> max(len(embedding)) THEN 'mixed' WHEN min(len(embedding)) <> 64 THEN 'mismatch' ELSE 'ok' END AS status FROM embeddings GROUP BY label")
def vector_status(spark, sf_dir):
    return X.index_status(table(spark, sf_dir, "embeddings"), "label", "embedding", 64)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, sf_dir):
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(have, "doc_id", "left_anti")


MENTIONS_SQL = "(SELECT DISTINCT 'n' || (l_partkey % 60) AS source, 'n' || (l_suppkey % 60) AS target, l_returnflag AS type, l_orderkey % 300 AS doc_id, l_linenumber AS chunk_index FROM lineitem)"


def mentions(spark, sf_dir):
    node = lambda c: F.concat(F.lit("n"), (F.col(c) % 60).cast("string"))
    return table(spark, sf_dir, "lineitem").select(node("l_partkey").alias("source"), node("l_suppkey").alias("target"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") % 300).alias("doc_id"), F.col("l_linenumber").alias("chunk_index"))


@query(f"""SELECT name, count(*) AS "count" FROM (SELECT source AS name, doc_id, chunk_index FROM {MENTIONS_SQL} WHERE doc_id <> 7 UNION SELECT target, doc_id, chunk_index FROM {MENTIONS_SQL} WHERE doc_id <> 7) GROUP BY name""")
def graph_without_document(spark, sf_dir):
    return X.without_document(mentions(spark, sf_dir), 7)[0]


@query(f"SELECT source, target, type, count(*)::DOUBLE AS weight FROM {MENTIONS_SQL} WHERE doc_id <> 7 GROUP BY ALL")
def relations_without_document(spark, sf_dir):
    return X.without_document(mentions(spark, sf_dir), 7)[1]


@query("SELECT doc_id, CASE WHEN strpos(lower(text), 'tion') > 0 THEN strpos(lower(text), 'tion') - 1 ELSE 0 END AS char_start, CASE WHEN strpos(lower(text), 'tion') > 0 THEN strpos(lower(text), 'tion') + 3 ELSE n_chars END AS char_end FROM documents")
def entity_offsets(spark, sf_dir):
    a, b = X.located(F.col("text"), F.lit("TION"), F.lit(0), F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", a.cast("long").alias("char_start"), b.cast("long").alias("char_end"))


@query(f"""WITH e AS (SELECT source, target, type, count(*) AS weight FROM {MENTIONS_SQL} WHERE source <> target GROUP BY ALL)
SELECT source, string_agg(target || ' (' || type || ', ' || weight || ')', '; ' ORDER BY weight DESC, target, type) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target, type) AS r FROM e) WHERE r <= 40 GROUP BY source""")
def graph_context(spark, sf_dir):
    """The text that a prompt gets of each entity's 40 heaviest relations."""
    e = mentions(spark, sf_dir).distinct().where("source <> target").groupBy("source", "target", "type").agg(F.count("*").alias("weight"))
    top = e.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target", "type"))).where("r <= 40")
    line = F.concat("target", F.lit(" ("), "type", F.lit(", "), F.col("weight").cast("string"), F.lit(")"))
    return top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("t")))).alias("l")).select("source", F.array_join(F.col("l.t"), "; ").alias("lines"))


@query("""SELECT c_custkey, string_agg(n_name, ',' ORDER BY i) AS base_names FROM (SELECT c_custkey, unnest([c_nationkey, c_nationkey + 3, c_nationkey + 9]) AS k, unnest([0, 1, 2]) AS i FROM customer) JOIN nation ON n_nationkey = k GROUP BY c_custkey""")
def config_bases(spark, sf_dir):
    """The bases of each configuration by name, in their order; deleted ones are left out."""
    each = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array(F.col("c_nationkey"), F.col("c_nationkey") + 3, F.col("c_nationkey") + 9)).alias("i", "n_nationkey"))
    named = each.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return named.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("i", "n_name"))).alias("l")).select("c_custkey", F.array_join(F.col("l.n_name"), ",").alias("base_names"))


@query("""WITH r AS (SELECT doc_id % 30 AS g, doc_id AS a, doc_id + 1 + n_chars % 97 AS b FROM documents), s AS (SELECT g, p, sum(step) AS step FROM (SELECT g, a AS p, 1 AS step FROM r UNION ALL SELECT g, b, -1 FROM r) GROUP BY g, p),
t AS (SELECT g, p AS "start", lead(p) OVER w AS "end", sum(step) OVER (PARTITION BY g ORDER BY p)::BIGINT AS covers FROM s WINDOW w AS (PARTITION BY g ORDER BY p)) SELECT * FROM t WHERE "end" IS NOT NULL AND covers > 0""")
def overlap_segments(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select((F.col("doc_id") % 30).alias("g"), F.col("doc_id").alias("start"), (F.col("doc_id") + 1 + F.col("n_chars") % 97).alias("end"))
    return X.segments(r, "g")


@query("SELECT conv_id, string_agg('**' || role || '** ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def session_export(spark, sf_dir):
    """Conversations as Markdown, messages whole; a conversation's own length bounds its row."""
    line = F.concat(F.lit("**"), "role", F.lit("** "), "text")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))).alias("l"))
    return c.select("conv_id", F.array_join(F.col("l.t"), "\n\n").alias("markdown"))


@query(r"""SELECT doc_id, i - 1 AS n, regexp_matches(p, '^\s*(```|~~~)') OR sum(CASE WHEN regexp_matches(p, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER w % 2 = 1 AS protected
FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 5 = 2 THEN '```' ELSE 'x' || replace(l, '|', '') END) AS ps FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def protected_lines(spark, sf_dir):
    """Lines of fenced code, in texts whose every fifth line is a fence."""
    line = lambda l, i: F.when((i + 1) % 5 == 2, F.lit("```")).otherwise(F.concat(F.lit("x"), F.replace(l, F.lit("|"), F.lit(""))))  # noqa: E731, E741
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    return X.fenced_lines(pieces_of(d, "doc_id", "text", r"\n"), "doc_id").select("doc_id", F.col("n").cast("long").alias("n"), "protected")


@query("SELECT user_id, session, began FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY began DESC, session DESC) AS r FROM (SELECT user_id, event_id % 13 AS session, min(ts) AS began FROM events GROUP BY ALL)) WHERE r <= 5")
def newest_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("session", F.col("event_id") % 13)
    return X.newest_sessions(e, "user_id", "ts", 5)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 1) OR doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 12 = 1)")
def after_restore(spark, sf_dir):
    """Documents that show once some are deleted (tombstones) and some of those restored."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    tombstones = d.where("doc_id % 4 = 1").select("doc_id").join(d.where("doc_id % 12 = 1").select("doc_id"), "doc_id", "left_anti")
    return d.join(tombstones, "doc_id", "left_anti")


@query("""WITH p AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
w AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(text) - 2), lambda i: substring(text, i, 4))) AS a, list_distinct(list_transform(range(1, length(before) - 2), lambda i: substring(before, i, 4))) AS b FROM p WHERE role = 'assistant' AND before IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END, 6) AS share FROM w""")
def answer_overlap(spark, sf_dir):
    """How much of each answer stands in the question before it."""
    talk = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lag("text").over(talk).alias("before")).where("role = 'assistant' AND before IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(X.shared_share(F.col("text"), F.col("before")), 6).alias("share"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '<a href="/([^"]+)">', 1), lambda x: 'img/' || x))), ' ') AS refs,
md5(regexp_replace(html, '<a href="/([^"]+)">([^<]*)</a>', '![\2](/files/\1)', 'g')) AS rewritten FROM pages""")
def page_images(spark, sf_dir):
    """Image targets of pages, their links taken as images in Markdown, and the pages with targets of stored files."""
    from ..functions.text import image_refs

    md = F.regexp_replace("html", r'<a href="/([^"]+)">([^<]*)</a>', "![$2](img/$1)")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(image_refs(md)), " ").alias("refs"), F.md5(X.rewritten_images(md, "/files/")).alias("rewritten"))
