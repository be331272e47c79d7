"""What surrounds retrieval: rerank fallbacks, context texts, index status, graph upkeep, alignment, highlights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def usable_rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds rerank_score (missing ones filled with the query's least) and rank: the reranker's order, or the old one
    where it scored fewer than half of a query's hits or nothing above zero."""
    joined = hits.join(scores, ["query_id", "chunk_id"], "left")
    query = Window.partitionBy("query_id")
    valid = F.count("rerank_score").over(query)
    used = (2 * valid >= F.count("*").over(query)) & (F.max("rerank_score").over(query) > 0)
    marked = joined.withColumns({"used": F.coalesce(used, F.lit(False)), "filled": F.coalesce("rerank_score", F.min("rerank_score").over(query))})
    order = query.orderBy(F.desc(F.when(F.col("used"), F.col("filled")).otherwise(0.0)), "rank")
    return marked.withColumn("new_rank", F.row_number().over(order)).select("query_id", "chunk_id", F.when(F.col("used"), F.col("filled")).alias("rerank_score"), F.col("new_rank").alias("rank"))


def contexts(hits: DataFrame, chunks: DataFrame, top: int) -> DataFrame:
    """The texts of each query's best hits in rank order, the parent's text where there is one: query_id, contexts."""
    rows = hits.where(F.col("rank") <= top).join(chunks.select("chunk_id", F.coalesce("parent_text", "text").alias("text")), "chunk_id")
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))


def cited(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, rank, score, vector_score) as sources: with the chunk's fields, scores of four digits.

    ``chunks``: chunk_id, text, retrieval_mode, parent_text and more. The parent's text is given only where
    the mode is ``parent`` and there is one.
    """
    parent = F.when((F.col("retrieval_mode") == "parent") & (F.col("parent_text") != ""), F.col("parent_text"))
    shown = chunks.withColumn("parent_text", parent).drop("retrieval_mode")
    return hits.join(shown, "chunk_id").withColumns({"score": F.round("score", 4), "vector_score": F.round("vector_score", 4)})


def with_graph_source(sources: DataFrame, graph: DataFrame) -> DataFrame:
    """``sources`` (query_id, rank, chunk_id string, document_name, text, score) and, behind the last of each query, its text from the graph (query_id, context) with score 0.

    A query without sources gets it at rank 1; an empty text gives none.
    """
    last = sources.groupBy("query_id").agg(F.max("rank").alias("_last"))
    told = graph.where(F.coalesce(F.trim("context"), F.lit("")) != "").join(last, "query_id", "left")
    pseudo = told.select("query_id", (F.coalesce("_last", F.lit(0)) + 1).cast(sources.schema["rank"].dataType).alias("rank"), F.concat(F.lit("kg:"), F.col("query_id").cast("string")).alias("chunk_id"), F.lit("知识图谱").alias("document_name"), F.col("context").alias("text"), F.lit(0.0).alias("score"))
    return sources.select(*pseudo.columns).unionByName(pseudo)


def with_contexts(samples: DataFrame, hits: DataFrame, chunks: DataFrame, top: int) -> DataFrame:
    """``samples`` (query_id and more) with contexts: the texts of their best ``top`` hits, white space around them and empty ones left out; none where nothing was found."""
    found = contexts(hits, chunks, top)
    bare = F.filter(F.transform("contexts", strip), lambda t: t != "")
    return samples.join(found.withColumn("contexts", bare), "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def mean_scores(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, sources, mean_score of each query; null where it has no hits."""
    found = hits.groupBy("query_id").agg(F.count("*").alias("sources"), F.avg("score").alias("mean_score"))
    return queries.select("query_id").distinct().join(found, "query_id", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))


def distinct_in_order(hits: DataFrame, column: str) -> DataFrame:
    """query_id and the distinct values of ``column`` in the order in which a query's ranking has them first."""
    first = hits.where(F.col(column).isNotNull()).groupBy("query_id", column).agg(F.min("rank").alias("rank"))
    listed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", column))).alias("l"))
    return listed.select("query_id", F.col(f"l.{column}").alias(column))


def index_status(vectors: DataFrame, base_col: str, vector_col: str, dim: int) -> DataFrame:
    """Per base: vectors, dim (the least), status (ok, mixed or mismatch with the model's ``dim``)."""
    size = F.size(vector_col)
    found = vectors.groupBy(base_col).agg(F.count("*").alias("vectors"), F.min(size).alias("dim"), F.max(size).alias("most"))
    return found.select(base_col, "vectors", "dim", F.when(F.col("dim") != F.col("most"), "mixed").when(F.col("dim") != dim, "mismatch").otherwise("ok").alias("status"))


def without_document(mentions: DataFrame, doc_id) -> tuple[DataFrame, DataFrame]:
    """Entity counts and relation weights once a document is removed; entities without mentions and relations that lose an end go.

    ``mentions``: source, target, type, doc_id, chunk_index; an entity is mentioned where it is an end.
    """
    kept = mentions.where(F.col("doc_id") != doc_id)
    ends = kept.select(F.explode(F.array("source", "target")).alias("name"), "doc_id", "chunk_index").distinct()
    entities = ends.groupBy("name").agg(F.count("*").alias("count"))
    relations = kept.select("source", "target", "type", "doc_id", "chunk_index").distinct().groupBy("source", "target", "type").agg(F.count("*").cast("double").alias("weight"))
    return entities, relations


def located(chunk_text: Column, name: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Offsets of an entity in the full text: its first occurrence in the chunk, else the chunk's."""
    at = F.instr(F.lower(chunk_text), F.lower(name))
    return F.when(at > 0, start + at - 1).otherwise(start), F.when(at > 0, start + at - 1 + F.length(name)).otherwise(end)


def segments(ranges: DataFrame, id_col: str) -> DataFrame:
    """The elementary segments between all starts and ends of an id's ranges and how many ranges cover each: id, start, end, covers."""
    steps = ranges.select(id_col, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("s"))
    at = steps.groupBy(id_col, F.col("s.at").alias("start")).agg(F.sum("s.step").alias("step"))
    order = Window.partitionBy(id_col).orderBy("start")
    out = at.withColumns({"end": F.lead("start").over(order), "covers": F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return out.where("end IS NOT NULL AND covers > 0").select(id_col, "start", "end", "covers")


def fenced_lines(lines: DataFrame, id_col: str) -> DataFrame:
    """Adds protected: inside a fenced code block (an unclosed one reaches to the end) or a row of a Markdown table. ``lines``: id, n, piece."""
    order = Window.partitionBy(id_col).orderBy("n")
    fence = F.col("piece").rlike(r"^\s*(```|~~~)")
    opened = F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    row = F.col("piece").rlike(r"^\s*\|.*\|\s*$")
    beside = F.coalesce(F.lag(row).over(order), F.lit(False)) | F.coalesce(F.lead(row).over(order), F.lit(False))
    return lines.withColumn("protected", fence | (opened % 2 == 1) | (row & beside))


def rewritten_images(text: Column, prefix: str) -> Column:
    """Relative image targets replaced by ``prefix`` and their file name; absolute and data addresses stay."""
    return F.regexp_replace(text, r"(!\[[^\]]*\]\()(?!https?:|data:|/)(?:[^)\s]*/)?([^)/\s]+)", rf"$1{prefix}$2")


def shared_share(answer: Column, source: Column, width: int = 4) -> Column:
    """The share of an answer's distinct windows of ``width`` signs that the source has too; 0 for shorter answers."""

    @F.pandas_udf("double")
    def share(answers: pd.Series, sources: pd.Series) -> pd.Series:
        windows = lambda t: {t[i : i + width] for i in range(len(t) - width + 1)}
        both = ((windows(a or ""), windows(b or "")) for a, b in zip(answers, sources, strict=True))
        return pd.Series([len(a & b) / len(a) if a else 0.0 for a, b in both], dtype=float)

    return share(answer, source)


def newest_sessions(turns: DataFrame, key: str, time: str, most: int) -> DataFrame:
    """The ``most`` sessions of each key that began last; older ones have left the cache."""
    begun = turns.groupBy(key, "session").agg(F.min(time).alias("began"))
    order = Window.partitionBy(key).orderBy(F.desc("began"), F.desc("session"))
    return begun.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def document_again(mentions: DataFrame, doc_id, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph's mentions once a document's are made anew, and a row with doc_id, chunks, read and status.

    ``answers``: chunk_index, entities, relations as ``graph.extracted`` gives them. The old mentions go in any
    case; the document has failed if it has chunks and none of their answers could be read.
    """
    own = answers.select(F.explode("relations").alias("r"), "chunk_index").select("r.source", "r.target", "r.type", F.lit(doc_id).cast(mentions.schema["doc_id"].dataType).alias("doc_id"), "chunk_index")
    fresh = mentions.where(F.col("doc_id") != doc_id).select("source", "target", "type", "doc_id", "chunk_index").unionByName(own)
    read = answers.agg(F.count("*").alias("chunks"), F.count("entities").alias("read"))
    return fresh, read.select(F.lit(doc_id).alias("doc_id"), "chunks", "read", F.when((F.col("chunks") > 0) & (F.col("read") == 0), "failed").otherwise("done").alias("status"))
