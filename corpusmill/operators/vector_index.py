"""Nearest neighbours by an index: an inverted file of k-means cells with residual codes, in pages.

Centres are fitted on a bounded sample; every vector belongs to the cell of its nearest centre. A cell's
vectors stand in pages of a bounded size, rows of a table in a folder a cell. A page has the vectors'
differences to the centre as one byte a number, and the vectors themselves in another column, so that a
search reads a quarter of the bytes first: a query goes to the cells whose centres are nearest, the codes
give the candidates, and only pages with candidates are read for their exact scores. Queries travel in
blocks, as one matrix each; what meets in a task is one page and one block.

Cosine similarity is meant throughout; a zero vector has similarity 0 to all. The index is a version
(``sources.versions``): building it anew or adding to it swaps it in one step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written
from ..sources import versions
from . import products
from .products import matrix as _matrix
from .retrieval import in_blocks, top

#: Vectors in a page, queries in a block, cells at most, vectors the centres are fitted on.
PAGE, BLOCK, MOST_CELLS, SAMPLE = 1024, 512, 4096, 50_000


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows as they are."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _fitted(vectors: DataFrame, n: int, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of k-means over the unit vectors of at most about SAMPLE rows."""
    sample = vectors if n <= SAMPLE else vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 32)) < (SAMPLE << 32) // n)
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v))
    unit = F.transform("x", lambda v: v / F.when(size > 0, size).otherwise(1.0))
    return np.array(KMeans(k=cells, maxIter=rounds, seed=seed).fit(sample.select(array_to_vector(unit).alias("features"))).clusterCenters())


def _pages(vectors: DataFrame, centres: np.ndarray, batch: int) -> DataFrame:
    """Pages of all ``vectors`` (id, x): cell, batch, slice, ids, scales, codes, x."""
    dim, half = centres.shape[1], (centres**2).sum(1) / 2

    def cell(batches):
        for b in batches:
            found = (_unit(_matrix(b.column(1), dim)) @ centres.T - half).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], names=["id", "x", "cell"])

    kind = vectors.schema["id"].dataType.simpleString()
    placed = written(vectors.mapInArrow(cell, f"id {kind}, x array<double>, cell int"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("slices"))  # a row a cell
    sliced = placed.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))

    def page(key, rows):
        own, x = key[0].as_py(), _matrix(rows["x"].combine_chunks(), dim)
        rest = _unit(x) - centres[own]
        scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
        codes = np.rint(rest / scale[:, None]).astype(np.int8)
        ids = rows["id"].combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        columns = [pa.array([own], pa.int32()), pa.array([batch], pa.int32()), pa.array([key[1].as_py()], pa.int32()), lists, pa.array([list(scale)], pa.list_(pa.float64())), pa.array([codes.tobytes()]), pa.array([x.astype(np.float32).tobytes()])]
        return pa.Table.from_arrays(columns, names=["cell", "batch", "slice", "ids", "scales", "codes", "x"])

    # ids that repeat may fill a page beyond its size; they differ in nothing else that could be dealt by
    return sliced.select("id", "x", "cell", "slice").groupBy("cell", "slice").applyInArrow(page, f"cell int, batch int, slice int, ids array<{kind}>, scales array<double>, codes binary, x binary")


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x of the rows that have a vector of finite numbers."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))), F.lit(False))
    return vectors.where(whole).select(F.col(id_col).alias("id"), x.alias("x"))


def build(vectors: DataFrame, path: str, id_col: str, vector_col: str, cells: int | None = None, rounds: int = 10, seed: int = 42) -> versions.Version:
    """Indexes every row of ``vectors`` that has a vector of finite numbers, and makes this the current index in ``path``.

    ``cells``: the square root of the rows, 4,096 at most, if not given. Vectors of different lengths are an error.
    """
    rows, spark = written(_rows(vectors, id_col, vector_col), "vectors"), vectors.sparkSession
    n, least, most = rows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if n and least != most:
        raise ValueError(f"vectors of {least} and of {most} numbers")
    cells = max(1, min(MOST_CELLS, n, cells or round(n**0.5)))
    centres = _fitted(rows, n, cells, rounds, seed) if n else np.zeros((1, 1))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    return versions.publish(spark, path, {"centres": table.coalesce(1), "pages": _pages(rows, centres, 0)}, partition_by={"pages": ["cell"]})


def added(vectors: DataFrame, path: str, id_col: str, vector_col: str) -> versions.Version:
    """The index with ``vectors`` in place of those of the same ids, by the centres it has; the current one until all is written."""
    spark = vectors.sparkSession
    before = versions.current(spark, path)
    rows, centres, pages = written(_rows(vectors, id_col, vector_col), "vectors"), _centres(before, spark), before.read(spark, "pages")
    if rows.where(F.size("x") != centres.shape[1]).limit(1).count():
        raise ValueError(f"vectors that have not the {centres.shape[1]} numbers of the index")
    # pages that hold one of the ids are made anew, all others stay as they are
    held = pages.select("cell", "batch", "slice", F.explode("ids").alias("id"))
    touched = written(held.join(rows.select("id").distinct(), "id", "left_semi").select("cell", "batch", "slice").distinct(), "touched")
    key = ["cell", "batch", "slice"]
    dim = centres.shape[1]

    def out(batches):
        for b in batches:
            for ids, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                flat = np.frombuffer(x, np.float32).astype(np.float64).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type.value_type), pa.array(list(flat), pa.list_(pa.float64()))], names=["id", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    old = pages.join(touched, key, "left_semi").select("ids", "x").mapInArrow(out, f"id {kind}, x array<double>").join(rows.select("id"), "id", "left_anti")
    number = (pages.agg(F.max("batch")).first()[0] or 0) + 1
    united = pages.join(touched, key, "left_anti").unionByName(_pages(written(rows.unionByName(old), "renewed"), centres, number))
    return versions.publish(spark, path, {"centres": before.read(spark, "centres"), "pages": united}, partition_by={"pages": ["cell"]}, base=before)


def _centres(index: versions.Version, spark: SparkSession) -> np.ndarray:
    """At most MOST_CELLS rows."""
    return np.array([r.centre for r in index.read(spark, "centres").orderBy("cell").collect()])


def search(spark: SparkSession, path: str, queries: DataFrame, top_k: int, probes: int = 16, widen: int = 4, exact: bool = False) -> DataFrame:
    """The ``top_k`` nearest vectors of each query (query_id, vector) by the index: query_id, chunk_id, score, rank.

    ``probes``: how many cells a query is sent to; with all of them, and ``widen`` times ``top_k`` candidates that
    are scored exactly, the result is that of a search of all vectors but for candidates that the codes misjudge.
    ``exact``: the score that ``top_k`` of these reach then rules out the pages whose vectors are all too far from
    a query, by their distance from the centre; all others are scored, and the result is that of a search of all vectors.
    Scores have six digits, ties are in order of chunk_id. Vectors that are null or not of the index's length are an error.
    """
    index = versions.current(spark, path)
    pages, centres = index.read(spark, "pages"), _centres(index, spark)
    dim, probes, half = centres.shape[1], min(probes, len(centres)), (centres**2).sum(1) / 2
    asked = written(queries.select("query_id", F.col("vector").cast("array<double>").alias("q")), "asked")
    n, bad = asked.agg(F.count("*"), F.count_if(F.coalesce(F.size("q") != dim, F.lit(True)))).first()
    if bad:
        raise ValueError(f"{bad} queries have not the {dim} numbers of the index")
    kind, ids = asked.schema["query_id"].dataType.simpleString(), pages.schema["ids"].dataType.elementType.simpleString()
    wide = top_k * widen

    def probe(batches):
        for b in batches:
            order = np.argsort(half - _unit(_matrix(b.column(1), dim)) @ centres.T, axis=1)[:, :probes]
            at = pa.array(np.repeat(np.arange(b.num_rows), probes))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(order.ravel(), pa.int32())], names=["query_id", "q", "cell"])

    def block(key, rows):
        q = _matrix(rows["q"].combine_chunks(), dim)
        names = rows["query_id"].combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), lists, pa.array([q.tobytes()])], names=["cell", "block", "query_ids", "q"])

    spread = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // BLOCK)))).cast("int")
    sent = asked.mapInArrow(probe, f"query_id {kind}, q array<double>, cell int").withColumn("block", spread)
    blocks = written(sent.groupBy("cell", "block").applyInArrow(block, f"cell int, block int, query_ids array<{kind}>, q binary"), "blocks")

    def coarse(batches):
        for b in batches:
            for i, (cell, batch, slice_, scales, codes, q) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cell", "batch", "slice", "scales", "codes", "q")), strict=True)):
                unit = _unit(np.frombuffer(q).reshape(-1, dim))
                score = unit @ centres[cell][:, None] + (unit @ np.frombuffer(codes, np.int8).reshape(-1, dim).T.astype(np.float64)) * np.array(scales)
                keep = min(wide, score.shape[1])
                best = np.argpartition(-score, keep - 1, axis=1)[:, :keep].ravel()
                rows = np.repeat(np.arange(len(unit)), keep)
                page = [pa.array(np.full(len(rows), v), pa.int32()) for v in (cell, batch, slice_)]
                yield pa.RecordBatch.from_arrays([b.column("query_ids")[i].values.take(pa.array(rows)), *page, pa.array(best, pa.int32()), pa.array(score[rows, best])], names=["query_id", "cell", "batch", "slice", "nth", "about"])

    met = pages.select("cell", "batch", "slice", "scales", "codes").join(blocks, "cell")
    rough = met.mapInArrow(coarse, f"query_id {kind}, cell int, batch int, slice int, nth int, about double")
    order = Window.partitionBy("query_id").orderBy(F.desc("about"), "cell", "batch", "slice", "nth")
    chosen = rough.withColumn("r", F.row_number().over(order)).where(F.col("r") <= wide).drop("r", "about").join(asked, "query_id")
    page = ["cell", "batch", "slice"]
    # a block's candidates of a page: BLOCK * wide at most
    wanted = chosen.groupBy(*page, spread.alias("block")).agg(F.collect_list(F.struct("query_id", "nth", "q")).alias("wanted"))

    def rescored(batches):
        for b in batches:
            for i, x in enumerate(b.column("x").to_pylist()):
                wanted = b.column("wanted")[i].values
                nth = wanted.field("nth").to_numpy()
                q, rows = _matrix(wanted.field("q"), dim), np.frombuffer(x, np.float32).reshape(-1, dim)[nth].astype(np.float64)
                size = np.linalg.norm(q, axis=1) * np.linalg.norm(rows, axis=1)
                score = np.where(size > 0, (q * rows).sum(1) / np.where(size > 0, size, 1), 0.0)
                yield pa.RecordBatch.from_arrays([wanted.field("query_id"), b.column("ids")[i].values.take(pa.array(nth)), pa.array(score)], names=["query_id", "chunk_id", "score"])

    scored = wanted.join(pages.select(*page, "ids", "x"), page).mapInArrow(rescored, f"query_id {kind}, chunk_id {ids}, score double")
    found = top(scored.withColumn("score", F.round("score", 6)), top_k)
    if not exact:
        return found
    reached = found.groupBy("query_id").agg(F.when(F.count("*") >= top_k, F.min("score")).alias("floor"))
    floored = asked.join(reached, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    blocks = written(floored.repartition(max(1, -(-n // products.BLOCK)), "query_id").mapInArrow(lambda b: products.vector_blocks(b, dim), f"query_ids array<{kind}>, q binary, floors binary"), "floors")
    found = None
    for some in in_blocks(blocks, products.BLOCK * (24 + 8 * dim)):
        near = pages.select("cell", "ids", "x").join(some).mapInArrow(lambda b: products.nearest(b, dim, top_k, np.float32, centres), f"query_id {kind}, chunk_id {ids}, score double")
        best = top(near.withColumn("score", F.round("score", 6)), top_k)
        found = best if found is None else found.unionByName(best)  # a query is in one block
    return found
