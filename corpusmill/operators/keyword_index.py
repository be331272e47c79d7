"""A stored keyword index: postings in blocks with maxima, additions and removals without a rebuild, searches that skip.

An index is a version (``sources.versions``) of three small tables over segments. A segment is written once
and never changed: ``docs`` has each chunk's terms with their counts, ``terms`` how many chunks have a term,
``postings`` the chunks of a term in blocks. Chunks form pages of a bounded size where they lie and a block holds a
term's chunks of one page, so no term, however common, is gathered whole, and no posting is shuffled as a row: blocks
are, once, to lie in folders by a hash of the term. A search reads the folders of its terms.

A chunk that is added again or removed leaves a tombstone: what older segments say of it counts no more, and
their counts of its terms are set off. ``merged`` writes one segment anew from the chunks that live.

A search first finds a score that k chunks reach, by the term of each query that weighs most. Terms that
together cannot reach it need not be looked up to find chunks, nor blocks whose maximum is too low; what is
left gives the candidates, and these alone are scored, with all terms. The result is that of the exact search.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..scratch import bounded_batches, written
from ..sources import versions
from .retrieval import B, BROADCAST_BYTES, K1, top

#: Folders of postings, chunks in a page (and in a block at most), segments before ``added`` asks for a merge.
BUCKETS, PAGE = 64, 4096
#: Postings of a page after which it takes no more batches of chunks; bytes of an id in a table sent to all executors.
PAGE_POSTINGS, ID_BYTES = 1 << 21, 64
#: What is stored of a chunk beside its id.
DOC = "doc_len int, terms array<struct<term: string, tf: int>>"
#: Scores are sums in any order and rounded to six digits: bounds give way by this much.
SLACK = 1e-5


@dataclass(frozen=True)
class Index:
    """The tables of a version as they are to be read."""

    version: versions.Version
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    tombstones: DataFrame

    def live_docs(self) -> DataFrame:
        """chunk_id, doc_len, terms of the chunks that count."""
        return _live(self.docs, self.tombstones)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _block(ids: str) -> str:
    """The columns of postings for ids of a type."""
    return f"term string, page long, chunk_ids array<{ids}>, tfs array<int>, doc_lens array<int>, most_tf int, least_len int"


def _live(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows (chunk_id, segment) that no later segment has replaced or removed."""
    dead = tombstones.groupBy(F.col("chunk_id").alias("_dead")).agg(F.max("before").alias("_before"))
    return rows.join(dead, (F.col("chunk_id") == F.col("_dead")) & (F.col("segment") < F.col("_before")), "left_anti")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk_id, doc_len, terms (the distinct ones, each with its count) from chunk_id and t, the terms of a text."""
    for b in batches:
        lists = b.column("t")
        sizes, words = np.diff(lists.offsets.to_numpy()), lists.flatten().dictionary_encode()
        kinds = max(1, len(words.dictionary))
        key, tf = np.unique(np.repeat(np.arange(len(lists)), sizes) * kinds + words.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(key, kinds)
        starts = np.r_[0, np.cumsum(np.bincount(row, minlength=len(lists)))].astype(np.int32)
        pairs = pa.StructArray.from_arrays([words.dictionary.take(pa.array(code)), pa.array(tf.astype(np.int32))], ["term", "tf"])
        yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(starts), pairs)], names=["chunk_id", "doc_len", "terms"])


def _docs(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """chunk_id, doc_len, terms of every chunk; one without terms has a length of 0."""
    bounded_batches(chunks.sparkSession)
    tokens = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), terms(F.col(text_col)).alias("t"))
    return tokens.mapInArrow(_counted, f"chunk_id {tokens.schema['chunk_id'].dataType.simpleString()}, {DOC}")


def _pages(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    """The blocks of each page, ``chunks`` chunks at most, from chunk_id, doc_len, terms. Pages are numbered by task."""
    page, held, rows, size = TaskContext.get().partitionId() << 32, [], 0, 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, chunks - rows)
            b = b.slice(part.num_rows)
            held.append(part)
            rows, size = rows + part.num_rows, size + len(part.column("terms").flatten())
            if rows == chunks or size >= PAGE_POSTINGS:
                yield _page(held, page)
                page, held, rows, size = page + 1, [], 0, 0
    if held:
        yield _page(held, page)


def _page(held: list[pa.RecordBatch], page: int) -> pa.RecordBatch:
    """term, page, chunk_ids, tfs, doc_lens, most_tf, least_len: a row for each term of the page."""
    ids, lens, lists = pa.Table.from_batches(held).select(["chunk_id", "doc_len", "terms"]).combine_chunks().to_batches()[0].columns
    word, tf = lists.flatten().flatten()
    words = word.dictionary_encode()
    order = np.argsort(words.indices.to_numpy(), kind="stable")
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[order]
    tf, size = tf.to_numpy()[order], lens.to_numpy()[row]
    starts = np.r_[0, np.cumsum(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))].astype(np.int32)
    listed = lambda values: pa.ListArray.from_arrays(pa.array(starts), values)
    most, least = (f.reduceat(v, starts[:-1]) if len(v) else v for f, v in ((np.maximum, tf), (np.minimum, size)))
    columns = [words.dictionary, pa.array(np.full(len(most), page)), listed(ids.take(pa.array(row))), listed(pa.array(tf)), listed(pa.array(size)), pa.array(most), pa.array(least)]
    return pa.RecordBatch.from_arrays(columns, names=["term", "page", "chunk_ids", "tfs", "doc_lens", "most_tf", "least_len"])


def _sent(ids: DataFrame) -> DataFrame:
    """``ids``, a written table, to be sent to all executors if it is small."""
    return F.broadcast(ids) if ids.count() * ID_BYTES <= BROADCAST_BYTES else ids


def _write_docs(docs: DataFrame, path: str) -> tuple[str, DataFrame]:
    """The documents of a new segment, written into its folder: its token, and they as read again."""
    token = uuid.uuid4().hex
    at = f"{path}/segments/{token}/docs"
    docs.write.option("compression", "zstd").parquet(at)
    return token, docs.sparkSession.read.schema(docs.schema).parquet(at)


def _write_terms(docs: DataFrame, lost: DataFrame, path: str) -> None:
    """Postings and terms of a segment whose ``docs`` are written; ``lost``: terms of live chunks that it replaces, a row each."""
    spark, chunks, ids = docs.sparkSession, PAGE, docs.schema["chunk_id"].dataType.simpleString()
    bounded_batches(spark)
    blocks = docs.mapInArrow(lambda b: _pages(b, chunks), _block(ids)).withColumn("bucket", _bucket(F.col("term")))
    blocks = blocks.repartition("bucket", F.pmod(F.xxhash64("page"), F.lit(16))).sortWithinPartitions("bucket", "term")
    blocks.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(f"{_block(ids)}, bucket int").parquet(f"{path}/postings")
    gone = lost.groupBy("term").agg((-F.count("*")).alias("df"))
    counts = stored.select("term", F.size("tfs").cast("long").alias("df")).unionByName(gone).withColumn("bucket", _bucket(F.col("term")))
    # dealt by bucket first: the sums need no shuffle of their own then
    counts = counts.repartition("bucket").groupBy("bucket", "term").agg(F.sum("df").alias("df"))
    counts.select("term", "df", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/terms")


def _published(spark: SparkSession, path: str, before: versions.Version | None, kept: list[tuple[int, str]], number: int, token: str, docs: DataFrame, tombstones: DataFrame, gone: DataFrame, lost: DataFrame) -> versions.Version:
    """The new segment ``token`` of ``docs`` completed, beside those kept, and the version that has it. ``gone``: chunk_id, doc_len of live chunks that it replaces."""
    n, length = docs.agg(F.count("*"), F.sum("doc_len")).first()
    n_gone, length_gone = gone.agg(F.count("*"), F.sum("doc_len")).first()
    _write_terms(docs, lost, f"{path}/segments/{token}")
    was = before.read(spark, "corpus").first() if kept and before else (0, 0)
    corpus = spark.createDataFrame([(was[0] + n - n_gone, was[1] + (length or 0) - (length_gone or 0))], "n long, length long")
    segments = spark.createDataFrame([*kept, (number, token)], "segment long, token string")
    return versions.publish(spark, path, {"segments": segments.coalesce(1), "corpus": corpus.coalesce(1), "tombstones": tombstones}, base=before)


def read(spark: SparkSession, path: str) -> Index:
    """The current index in ``path``."""
    at = versions.current(spark, path)
    if at is None:
        raise FileNotFoundError(f"no index in {path}")
    segments = [tuple(r) for r in at.read(spark, "segments").collect()]  # a row a segment
    ids = at.read(spark, "tombstones").schema["chunk_id"].dataType.simpleString()
    kinds = {"postings": f"{_block(ids)}, bucket int", "terms": "term string, df long, bucket int", "docs": f"chunk_id {ids}, {DOC}"}
    tables = {k: reduce(DataFrame.unionByName, [spark.read.schema(s).parquet(f"{path}/segments/{token}/{k}").withColumn("segment", F.lit(n).cast("long")) for n, token in segments]) for k, s in kinds.items()}
    return Index(at, tombstones=at.read(spark, "tombstones"), **tables)


def _kept(index: Index, spark: SparkSession) -> list[tuple[int, str]]:
    return sorted(tuple(r) for r in index.version.read(spark, "segments").collect())


def build(chunks: DataFrame, path: str, id_col: str, text_col: str) -> versions.Version:
    """Indexes all ``chunks`` and makes this the current index. Ids are unique; a chunk whose id is null is left out, a null text has no terms."""
    spark, (token, docs) = chunks.sparkSession, _write_docs(_docs(chunks, id_col, text_col), path)
    none = docs.where("false")
    return _published(spark, path, versions.current(spark, path), [], 1, token, docs, none.select("chunk_id", F.lit(0).cast("long").alias("before")), none, none.select(F.lit("").alias("term")))


def added(chunks: DataFrame, path: str, id_col: str, text_col: str) -> versions.Version:
    """The index with ``chunks`` too, in place of those of the same ids: one more segment, the others stay as they are."""
    spark = chunks.sparkSession
    index, (token, docs) = read(spark, path), _write_docs(_docs(chunks, id_col, text_col), path)
    return _changed(spark, path, index, token, docs, docs.select("chunk_id"))


def removed(ids: DataFrame, path: str, id_col: str) -> versions.Version:
    """The index without the chunks of ``ids``; ids that are not in it do no harm."""
    spark = ids.sparkSession
    index = read(spark, path)
    token, none = _write_docs(index.docs.drop("segment").where("false"), path)
    return _changed(spark, path, index, token, none, ids.select(F.col(id_col).alias("chunk_id")))


def _changed(spark: SparkSession, path: str, index: Index, token: str, docs: DataFrame, ids: DataFrame) -> versions.Version:
    kept = _kept(index, spark)
    number = max(n for n, _ in kept) + 1
    # found by ids alone; terms are read only of what is gone
    live = _live(index.docs.select("chunk_id", "doc_len", "segment"), index.tombstones)
    gone = written(live.join(ids, "chunk_id", "left_semi"), "gone")
    lost = index.docs.join(_sent(gone.select("chunk_id", "segment")), ["chunk_id", "segment"], "left_semi").select(F.explode("terms.term").alias("term"))
    tombstones = index.tombstones.unionByName(gone.select("chunk_id", F.lit(number).cast("long").alias("before")))
    return _published(spark, path, index.version, kept, number, token, docs, tombstones, gone, lost)


def merged(spark: SparkSession, path: str) -> versions.Version:
    """The index in one segment, made of the terms of the chunks that live; no text is read. ``versions.forget`` and the old segments may go then."""
    index = read(spark, path)
    token, docs = _write_docs(index.live_docs().drop("segment"), path)
    number, none = max(n for n, _ in _kept(index, spark)) + 1, docs.where("false")
    return _published(spark, path, index.version, [], number, token, docs, index.tombstones.where("false"), none, none.select(F.lit("").alias("term")))


def search(spark: SparkSession, path: str, queries: DataFrame, query_id: str, query_text: str, top_k: int) -> DataFrame:
    """The best ``top_k`` chunks of each query with a score above 0: query_id, chunk_id, score, rank, as ``retrieval.bm25`` gives them for the chunks that live."""
    index = read(spark, path)
    n, length = index.version.read(spark, "corpus").first()
    words = queries.select(F.col(query_id).alias("query_id"), F.explode_outer(F.array_distinct(terms(F.col(query_text)))).alias("term")).where("term IS NOT NULL")
    words = written(words.withColumn("bucket", _bucket(F.col("term"))), "asked")
    buckets = [r.bucket for r in words.select("bucket").distinct().collect()]  # BUCKETS at most
    df = index.terms.where(F.col("bucket").isin(buckets)).join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    asked = written(words.join(df, "term").select("query_id", "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "weights")
    part = lambda tf, size: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (length / max(n, 1) or 1)))

    # what the queries need of the index, read once
    held = index.postings.where(F.col("bucket").isin(buckets)).join(asked.select("term").distinct(), "term", "left_semi")
    held = written(held.select("term", "segment", "page", "chunk_ids", "tfs", "doc_lens", "most_tf", "least_len"), "blocks")
    bounds = asked.join(held.select("term", "segment", "page", "most_tf", "least_len"), "term").withColumn("most", part(F.col("most_tf"), F.col("least_len")))
    of_term = bounds.groupBy("query_id", "term").agg(F.first("idf").alias("idf"), F.max("most").alias("most"))

    def scored(blocks: DataFrame) -> DataFrame:
        """query_id, term, chunk_id, part of blocks (query_id, term, idf, segment, chunk_ids, tfs, doc_lens)."""
        one = blocks.select("query_id", "term", "idf", "segment", F.explode(F.arrays_zip("chunk_ids", "tfs", "doc_lens")).alias("c")).select("query_id", "term", "idf", "segment", F.col("c.chunk_ids").alias("chunk_id"), "c.tfs", "c.doc_lens")
        return _live(one, index.tombstones).select("query_id", "term", "chunk_id", part(F.col("tfs"), F.col("doc_lens")).alias("part"))

    # a score that top_k chunks of each query reach by one term alone
    strongest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "term"))
    lead = of_term.withColumn("r", strongest).where("r = 1").select("query_id", "term", "idf")
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "chunk_id"))
    reached = scored(lead.join(held, "term")).withColumn("r", kth).where(F.col("r") <= top_k).groupBy("query_id").agg(F.when(F.count("*") >= top_k, F.min("part") - SLACK).otherwise(0.0).alias("reached"))
    # terms from the weakest on, as long as all of them together do not reach it, give no candidates
    upto = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("most").over(Window.partitionBy("query_id"))
    rated = of_term.withColumns({"upto": upto, "others": total - F.col("most")}).join(reached, "query_id")
    needed = written(rated.where(F.col("upto") >= F.col("reached")).select("query_id", "term", "others", "reached"), "needed")
    blocks = bounds.join(needed, ["query_id", "term"]).where(F.col("most") + F.col("others") >= F.col("reached")).select("query_id", "term", "segment", "page")
    found = blocks.join(held.select("term", "segment", "page", F.col("chunk_ids").alias("ids")), ["term", "segment", "page"])
    candidates = found.select("query_id", F.explode("ids").alias("chunk_id")).distinct()
    parts = scored(asked.join(held, "term")).join(candidates, ["query_id", "chunk_id"], "left_semi")
    return top(parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0"), top_k)
