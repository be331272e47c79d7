"""Retrieval over batches of queries: keyword and vector search, fusion, thresholds, reranking, merging.

Every operator takes DataFrames keyed by ``query_id`` and returns ranked rows; one plan answers all
queries. Rankings end in a unique key, so ties have one order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..functions.vectors import cosine, norm
from ..scratch import written
from . import products

#: Constants of the keyword score and of rank fusion.
K1, B, RRF_K = 1.5, 0.75, 60
#: A table below this size may be sent to all executors.
BROADCAST_BYTES = 32 << 20


def in_blocks(df: DataFrame, bytes_per_row: int) -> Iterator[DataFrame]:
    """``df`` as tables that may each be broadcast, by a hash of its rows; all of it at once if it is small."""
    blocks = max(1, -(-df.count() * bytes_per_row // BROADCAST_BYTES))
    for i in range(blocks):
        yield F.broadcast(df if blocks == 1 else df.where(F.pmod(F.xxhash64(*df.columns), F.lit(blocks)) == i))


def active(rows: DataFrame) -> DataFrame:
    """Rows of documents that are not in the trash: doc_active true or missing."""
    return rows.where(F.coalesce(F.col("doc_active"), F.lit(True)))


def _tokens(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """chunk_id and t, the terms of its text in order."""
    return chunks.select(F.col(id_col).alias("chunk_id"), terms(F.col(text_col)).alias("t"))


def _postings(tokens: DataFrame) -> DataFrame:
    sized = F.transform("t", lambda x: F.struct(x.alias("term"), F.size("t").alias("doc_len")))
    # explode would filter on the size of the array first, and so cut each text into terms twice
    counted = tokens.select("chunk_id", F.explode_outer(sized).alias("t")).where("t IS NOT NULL").select("chunk_id", "t.term", "t.doc_len")
    return counted.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The inverted index: term, chunk_id, tf, doc_len. Null texts have no terms."""
    return _postings(_tokens(chunks, id_col, text_col))


def term_counts(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, df (chunks that have it), occurrences: what ``postings`` sums up to, without a row for a posting.

    A row's terms are counted where it lies, its distinct ones before all of them. Rows that share an id are one
    chunk; only these go by their postings.
    """
    shared = written(chunks.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"), "shared-ids")
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    several = not shared.isEmpty()
    own = chunks.join(shared, same, "left_anti") if several else chunks
    both = _tokens(own, id_col, text_col).select("t", F.array_distinct("t").alias("d")).select(F.size("d").alias("n"), F.concat("d", "t").alias("all"))
    # explode would filter on the size of the array first, and so cut each text into terms twice
    one = both.select("n", F.posexplode_outer("all").alias("at", "term")).where("term IS NOT NULL")
    first = F.col("at") < F.col("n")
    counts = one.groupBy("term").agg(F.count_if(first).alias("df"), F.count_if(~first).alias("occurrences"))
    if several:
        joint = postings(chunks.join(shared, same, "left_semi"), id_col, text_col).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
        counts = counts.unionByName(joint).groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))
    return counts


def bm25(chunks: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, top_k: int) -> DataFrame:
    """The best ``top_k`` chunks of each query with a score above 0: query_id, chunk_id, score, rank.

    idf is ln(1 + (N - df + .5) / (df + .5)) over all chunks; each distinct term of a query counts
    once. Only postings of terms that occur in a query are scored. Counts are pre-aggregated, so a very common
    term shuffles one row per chunk. Texts are cut into terms once: what the queries need of the index is
    written, and serves counts and scores, while the lengths of all chunks are summed on the way. Chunks and
    queries meet as pages and blocks (``products``), so that no pair of them is ever a row.
    """
    asked, wanted, n, length = _wanted(chunks, queries, id_col, text_col, query_id, query_text)
    numbered = wanted.groupBy("term").agg(F.count("*").alias("df")).withColumn("number", F.monotonically_increasing_id())
    numbered = written(numbered.select("term", "number", _weight(n).alias("weight")), "terms")
    parts = wanted.join(numbered, "term").select("chunk_id", F.struct("number", _part(n, length).alias("part")).alias("p"))
    listed = parts.groupBy("chunk_id").agg(F.collect_list("p").alias("p")).select("chunk_id", "p.number", "p.part")  # a chunk's terms
    of_query = asked.join(numbered, "term").groupBy("query_id").agg(F.collect_set("number").alias("number"))
    ids, names = (d.schema[c].dataType.simpleString() for d, c in ((listed, "chunk_id"), (of_query, "query_id")))
    pages = listed.mapInArrow(products.weight_pages, f"ids array<{ids}>, terms binary, rows binary, parts binary")
    of_query = written(of_query, "asked-terms")
    blocks = _blocks(of_query, products.term_blocks, f"query_ids array<{names}>, asked binary, queries binary")
    width = of_query.agg(F.max(F.size("number"))).first()[0] or 1
    found = None
    for block in in_blocks(blocks, products.BLOCK * (16 + 12 * width)):
        scored = pages.join(block).mapInArrow(lambda b: products.heaviest(b, top_k), f"query_id {names}, chunk_id {ids}, score double")
        best = top(scored.withColumn("score", F.round("score", 6)).where("score > 0"), top_k)
        found = best if found is None else found.unionByName(best)  # a query is in one block
    return found


def _blocks(queries: DataFrame, pack: Callable, schema: str) -> DataFrame:
    """``queries`` packed into blocks by ``pack``, written."""
    return written(queries.repartition(max(1, -(-queries.count() // products.BLOCK)), "query_id").mapInArrow(pack, schema), "blocks")


def _wanted(chunks: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str) -> tuple[DataFrame, DataFrame, int, int]:
    """query_id and term of the queries; the postings of these terms, written; number and lengths of all chunks."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode_outer(F.array_distinct(terms(F.col(query_text)))).alias("term")).where("term IS NOT NULL")
    asked = written(asked, "asked")
    corpus = Observation()  # number and lengths of all chunks, seen while their terms pass by
    tokens = _tokens(chunks, id_col, text_col).observe(corpus, F.count(F.lit(1)).alias("n"), F.sum(F.size("t")).alias("length"))
    wanted = written(_postings(tokens).join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    return asked, wanted, corpus.get["n"], corpus.get["length"] or 0


def _weight(n: int) -> Column:
    """idf of a term that ``df`` of ``n`` chunks have."""
    return F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _part(n: int, length: int) -> Column:
    """What a term adds to a chunk's score: weight, tf, doc_len."""
    return F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / (length / max(n, 1) or 1)))


def _scored(chunks: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str) -> DataFrame:
    """query_id, chunk_id, score of all chunks with a score above 0."""
    asked, wanted, n, length = _wanted(chunks, queries, id_col, text_col, query_id, query_text)
    df = wanted.groupBy("term").agg(F.count("*").alias("df")).select("term", _weight(n).alias("weight"))
    scored = wanted.join(df, "term").select("term", "chunk_id", _part(n, length).alias("part"))
    return scored.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")


def fields_search(chunks: DataFrame, queries: DataFrame, id_col: str, fields: dict[str, float], query_id: str, query_text: str, top_k: int) -> DataFrame:
    """Keyword search over several columns: the sum of each column's scores times its weight, the best ``top_k``."""
    parts = [_scored(chunks, queries, id_col, c, query_id, query_text).withColumn("score", F.col("score") * w) for c, w in fields.items()]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    return top(united.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score")), top_k)


def top(scored: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` of each query by score, ties by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "chunk_id", "score", "rank")


def vector_search(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, top_k: int) -> DataFrame:
    """Exact cosine search of a stated set of queries (query_id, vector): query_id, chunk_id, score, rank.

    Vectors are packed into pages where they lie, queries into blocks that travel to them (``products``); what is
    shuffled is little more than top_k rows per query and task. Similarity with a zero vector, or one that is null
    or holds null, is 0. Vectors of another length or with numbers that are not finite go a plainer way.
    """
    own = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("v"))
    # written, since a query's vector may come from a model
    asked = written(queries.select("query_id", F.col("vector").alias("q")), "asked")
    width = asked.agg(F.max(F.size("q"))).first()[0] or 1
    ids, names = (d.schema[c].dataType.simpleString() for d, c in ((own, "chunk_id"), (asked, "query_id")))
    pages = _plain(own, "v", width).mapInArrow(lambda b: products.vector_pages(b, width, top_k), f"ids array<{ids}>, x binary")
    blocks = _blocks(_plain(asked, "q", width), lambda b: products.vector_blocks(b, width), f"query_ids array<{names}>, q binary")
    found = _by_pairs(own.where(~_is_plain("v", width)), asked, width)
    odd = asked.where(~_is_plain("q", width))
    if not odd.isEmpty():
        found = found.unionByName(_by_pairs(own.where(_is_plain("v", width)), odd, width))
    for block in in_blocks(blocks, products.BLOCK * (16 + 8 * width)):
        near = pages.join(block).mapInArrow(lambda b: products.nearest(b, width, top_k), f"query_id {names}, chunk_id {ids}, score double")
        found = found.unionByName(near.withColumn("score", F.round("score", 6)))
    return top(found, top_k)


def _is_plain(column: str, width: int) -> Column:
    """Is a vector null or one of ``width`` numbers that are null or finite, and no product of two overflows?"""
    fit = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < 1e150, F.lit(True)))
    return F.col(column).isNull() | ((F.size(column) == width) & fit)


def _plain(rows: DataFrame, column: str, width: int) -> DataFrame:
    """The rows with plain vectors, as doubles; zeros for null and for one that holds null."""
    whole = F.coalesce(F.forall(column, lambda x: x.isNotNull()), F.lit(False))
    zeros = F.array_repeat(F.lit(0.0), width)
    return rows.where(_is_plain(column, width)).withColumn(column, F.when(whole, F.col(column).cast("array<double>")).otherwise(zeros))


def _by_pairs(own: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """query_id, chunk_id, score of all pairs, for the few vectors that fit no page."""
    own = own.withColumn("nv", norm(F.col("v")))
    found = None
    for block in in_blocks(asked.withColumn("nq", norm(F.col("q"))), 32 + 8 * width):
        scored = own.join(block).select("query_id", "chunk_id", F.round(cosine(F.col("v"), F.col("q"), F.col("nv"), F.col("nq")), 6).alias("score"))
        found = scored if found is None else found.unionByName(scored)
    return found


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, top_k: int, min_score: float = 0.0) -> DataFrame:
    """Reciprocal rank fusion of two rankings: query_id, chunk_id, vector_score, keyword_score, score, rank.

    One shuffle: the rankings are united and summed by chunk. The threshold looks at the vector
    score where there is one, else at the keyword score as a share of the query's best. A query
    without keyword hits keeps its vector ranking and similarity.
    """
    both = vector_hits.select("query_id", "chunk_id", "rank", F.col("score").alias("v"), F.lit(None).cast("double").alias("k")).unionByName(keyword_hits.select("query_id", "chunk_id", "rank", F.lit(None).cast("double").alias("v"), F.col("score").alias("k")))
    fused = both.groupBy("query_id", "chunk_id").agg(F.max("v").alias("vector_score"), F.max("k").alias("keyword_score"), F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf"))
    query = Window.partitionBy("query_id")
    best = F.max("keyword_score").over(query)
    fused = fused.withColumns({"seen": F.coalesce("vector_score", F.col("keyword_score") / best), "score": F.round(F.when(best.isNull(), F.col("vector_score")).otherwise(F.col("rrf")), 6)})
    return _ranked(fused.where(F.col("seen") >= min_score), ["vector_score", "keyword_score"], top_k)


def _ranked(scored: DataFrame, keep: list[str], top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "chunk_id", *keep, "score", "rank")


def rerank(hits: DataFrame, scores: DataFrame, top_k: int) -> DataFrame:
    """Hits in the order of a reranker's scores (query_id, chunk_id, rerank_score); ones without keep their order behind the rest."""
    joined = hits.join(scores, ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return joined.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top_k).drop("rank").withColumnRenamed("new_rank", "rank")


def retrieve(
    chunks: DataFrame, queries: DataFrame, top_k: int = 5, min_score: float = 0.0, hybrid: bool = True, rerank_top: int | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None, dim: int | None = None
) -> DataFrame:
    """The whole search: query_id, chunk_id, vector_score, keyword_score, rerank_score, score, rank.

    ``chunks``: chunk_id, text, embedding, doc_active; ``queries``: query_id, text, vector. Both channels see
    active documents only and give ``max(top_k, rerank_top)`` candidates where a reranker follows; they are
    fused, cut by ``min_score``, put to ``reranker`` (hits with the texts of both sides -> query_id, chunk_id,
    rerank_score) and cut at ``top_k``. Queries whose vectors are not of ``dim`` numbers are an error.
    """
    if dim is not None and queries.where(F.size("vector") != dim).limit(1).count():
        raise ValueError(f"a query's vector has not the {dim} numbers of the index")
    live = active(chunks)
    wide = max(top_k, rerank_top or top_k) if reranker else top_k
    near = vector_search(live, queries, "chunk_id", "embedding", wide)
    words = bm25(live, queries, "chunk_id", "text", "query_id", "text", wide)
    hits = fuse(near, words if hybrid else words.where("false"), wide, min_score)
    if not reranker:
        return hits.withColumn("rerank_score", F.lit(None).cast("double"))
    hits = written(hits, "hits")  # a reranker reads them too
    texts = hits.join(live.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    return rerank(hits, reranker(texts), top_k)


def merge_bases(hits: DataFrame, base_col: str, per_base: int, top_k: int) -> DataFrame:
    """Hits of several bases merged: the best of each base, then the best of all by score rounded to 4 digits, ties by base and rank."""
    own = Window.partitionBy("query_id", base_col).orderBy(F.desc("score"), "chunk_id")
    kept = hits.withColumn("base_rank", F.row_number().over(own)).where(F.col("base_rank") <= per_base)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 4)), base_col, "base_rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
