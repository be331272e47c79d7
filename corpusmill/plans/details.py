"""Queries on sources, contexts, slices and groups: what a result looks like once it is found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import context as X
from ..operators import listing as L
from ..sources.tables import table
from .registry import query
from .retrieval import BM25_SQL, keyword_hits


def found(spark, sf_dir):
    return keyword_hits(spark, sf_dir).withColumn("vector_score", F.when(F.col("chunk_id") % 2 == 0, F.col("score") / 100))


@query(f"""WITH {BM25_SQL} SELECT query_id, rank, chunk_id, source, text, round(score, 4) AS score, CASE WHEN chunk_id % 2 = 0 THEN round(score / 100, 4) END AS vector_score,
CASE WHEN chunk_id % 3 = 0 AND lang <> 'en' THEN lang || ' of ' || source END AS parent_text FROM keyword JOIN documents ON doc_id = chunk_id""")
def cited_sources(spark, sf_dir):
    """Hits as sources; the parent's text only where the base works with parents and the chunk has one."""
    mode = F.when(F.col("doc_id") % 3 == 0, "parent").when(F.col("doc_id") % 3 == 1, "child")
    parent = F.when(F.col("lang") == "en", "").otherwise(F.concat_ws(" of ", "lang", "source"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text", mode.alias("retrieval_mode"), parent.alias("parent_text"))
    return X.cited(found(spark, sf_dir), chunks).select("query_id", "rank", "chunk_id", "source", "text", "score", "vector_score", "parent_text")


@query(f"""WITH {BM25_SQL}, s AS (SELECT query_id, rank, CAST(chunk_id AS VARCHAR) AS chunk_id, source AS document_name, text, score FROM keyword JOIN documents ON doc_id = chunk_id WHERE rank <= 5),
g AS (SELECT item_id AS query_id, 'graph of ' || text AS context FROM benchmark WHERE item_id % 25 = 0), l AS (SELECT query_id, max(rank) AS last FROM s GROUP BY query_id)
SELECT * FROM s UNION ALL SELECT query_id, CAST(coalesce(last, 0) + 1 AS BIGINT), 'kg:' || query_id, '知识图谱', context, 0.0 FROM g LEFT JOIN l USING (query_id)""")
def sources_with_graph(spark, sf_dir):
    """What a prompt gets: the five best sources, and behind them what the graph says."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_name"), "text")
    sources = keyword_hits(spark, sf_dir, 5).join(docs, "chunk_id").withColumns({"chunk_id": F.col("chunk_id").cast("string"), "rank": F.col("rank").cast("long")})
    graph = table(spark, sf_dir, "benchmark").where("item_id % 25 = 0").select(F.col("item_id").alias("query_id"), F.concat(F.lit("graph of "), "text").alias("context"))
    return X.with_graph_source(sources, graph)


@query(f"""WITH {BM25_SQL}, h AS (SELECT query_id, rank, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM keyword JOIN documents ON doc_id = chunk_id WHERE rank <= 3)
SELECT item_id AS query_id, text AS question, coalesce((SELECT string_agg(t, '|' ORDER BY rank) FROM h WHERE h.query_id = item_id AND t <> ''), '') AS contexts FROM benchmark""")
def sample_contexts(spark, sf_dir):
    """Samples with the texts that retrieval finds for their questions, empty where none was asked or found."""
    samples = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.lit(None).cast("string").alias("parent_text"))
    return X.with_contexts(samples, keyword_hits(spark, sf_dir), chunks, 3).withColumn("contexts", F.array_join("contexts", "|"))


@query(f"WITH {BM25_SQL} SELECT item_id AS query_id, count(score) AS sources, round(avg(score), 4) AS mean_score FROM benchmark LEFT JOIN keyword ON query_id = item_id GROUP BY item_id")
def mean_source_scores(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return X.mean_scores(queries, keyword_hits(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 4))


@query(f"WITH {BM25_SQL}, f AS (SELECT query_id, source, min(rank) AS rank FROM keyword JOIN documents ON doc_id = chunk_id GROUP BY ALL) SELECT query_id, string_agg(source, ',' ORDER BY rank) AS bases FROM f GROUP BY query_id")
def bases_in_order(spark, sf_dir):
    """The bases that a query's sources are of, in order of their best source."""
    bases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return X.distinct_in_order(keyword_hits(spark, sf_dir).join(bases, "chunk_id"), "source").select("query_id", F.array_join("source", ",").alias("bases"))


@query("SELECT conv_id AS dataset_id, turn AS idx, text FROM conversations WHERE turn >= 1 AND turn < 4")
def sample_slice(spark, sf_dir):
    """Three samples of each dataset from the second on."""
    samples = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("dataset_id"), F.col("turn").alias("idx"), "text")
    return L.sliced(samples, 1, 3)


@query("""WITH d AS (SELECT doc_id, source AS kb_id, CASE WHEN source < 'src13' THEN 2 WHEN source < 'src16' THEN 1 WHEN source < 'src3' THEN 9 END AS department_id FROM documents ORDER BY doc_id LIMIT 200),
b AS (SELECT department_id, kb_id, min(doc_id) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM d GROUP BY ALL),
g AS (SELECT department_id, min(n) AS n, string_agg(kb_id || ':' || docs, ';' ORDER BY n) AS bases FROM b GROUP BY department_id)
SELECT department_id, coalesce(CASE department_id WHEN 1 THEN 'one' WHEN 2 THEN 'two' END, '未分配部门') AS department_name,
CAST(row_number() OVER (ORDER BY CASE department_id WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 8 END, department_id IS NULL, n) AS INTEGER) AS place, bases FROM g""")
def documents_nested(spark, sf_dir):
    """A page of documents by department and base; a department that has none on it is left out, an unknown one and none come last."""
    kb = F.col("source")
    d = L.page(table(spark, sf_dir, "documents"), [F.col("doc_id")], 1, 200).select("doc_id", kb.alias("kb_id"), kb.alias("kb_name"), F.col("doc_id").alias("n"), F.when(kb < "src13", 2).when(kb < "src16", 1).when(kb < "src3", 9).alias("department_id"))
    departments = spark.range(1, 4).select(F.col("id").cast("int").alias("department_id"), F.element_at(F.array(F.lit("one"), F.lit("two"), F.lit("three")), F.col("id").cast("int")).alias("department_name"), F.col("id").alias("created_at"))
    line = F.array_join(F.transform("bases", lambda b: F.concat_ws(":", b["kb_id"], F.array_join(b["docs"].cast("array<string>"), ","))), ";")
    return L.nested(d, departments).withColumn("bases", line)


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE doc_id % 4 <> 3)
SELECT doc_id, 0 AS n, t AS text, '事实类' AS label FROM d WHERE t <> '' UNION ALL SELECT doc_id, CASE WHEN t <> '' THEN 1 ELSE 0 END, 'end of ' || doc_id, '其他' FROM d""")
def chunks_of_model(spark, sf_dir):
    """Chunks out of a model's answers, bare, fenced, among other text, or none."""
    own = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    chunk = lambda text, label: F.struct(text.alias("text"), F.lit(label).alias("label"))
    told = F.to_json(F.struct(F.array(chunk(own, "事实类"), chunk(F.lit(" "), "数据类"), chunk(F.concat(F.lit("end of "), F.col("doc_id").cast("string")), "odd")).alias("chunks")))
    kind = F.col("doc_id") % 4
    answer = F.when(kind == 0, told).when(kind == 1, F.concat(F.lit("```json\n"), told, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here they are: "), told, F.lit(" That is all."))).otherwise("I could not {do} it")
    return A.model_chunks(table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer")), "doc_id", "answer")
