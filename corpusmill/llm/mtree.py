"""Exact search for the highest inner products by best-first walks over an M-tree in pages.

The tree's root has the pivots, points of a bounded sample that lie far apart; each point belongs to its
nearest one. A pivot's points are dealt to slices of a bounded size, and each slice is a subtree, built in
one task: inner pages with routing points, the radius that covers all points below each, and its distance
to the page's own routing point; leaf pages with points and their distances to it. Pages are rows of a
table.

A walk takes the page with the least possible distance first and ends when no page left can hold a better
point than the k found. An entry whose stored distance to the page's routing point differs from the query's
by more than the radius and the bound allow is passed over, and its own distance is never computed.
A query first walks one subtree, the most promising; the k-th product found there is its bound for all
others, so that it is sent only to the subtrees that may hold better points. Queries travel in blocks, a
task holds one block and one subtree.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..scratch import written
from .metric import Space, as_queries, distances, matrix, nearest, on_sphere, pivots, points, products, spread_out

#: Points in a subtree and in a leaf page, entries in an inner page, pivots at most, queries in a block.
TREE_ROWS, LEAF, FANOUT, ROOTS, BLOCK = 4096, 128, 16, 256, 4096

PAGES = "cell int, slice int, page int, leaf boolean, child array<long>, id array<long>, x array<long>, to_parent array<double>, radius array<double>"
FOUND = "pos long, id long, score long, computed long"


def pages_of(x: np.ndarray, sphere: np.ndarray, top: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> list[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """The pages of a subtree below the routing point ``top``: leaf or not, entries (rows of ``x``), children (page numbers; rows in a leaf), distances to the page's point and radii. Page 0 is the first."""
    pages: list = [None]
    todo = [(0, np.arange(len(x)), top)]
    while todo:
        number, rows, point = todo.pop()
        if len(rows) <= leaf:
            pages[number] = True, rows, rows, distances(sphere[rows], point[None])[:, 0], np.zeros(len(rows))
            continue
        chosen = rows[spread_out(sphere[rows], min(fanout, -(-len(rows) // leaf)), seed=number)]
        d = distances(sphere[rows], sphere[chosen])
        own = d.argmin(1)
        if len(chosen) == 1:  # equal points: any cut is as good
            chosen = np.repeat(chosen, min(fanout, -(-len(rows) // leaf)))
            own, d = np.arange(len(rows)) % len(chosen), np.repeat(d, len(chosen), 1)
        parts = [np.flatnonzero(own == i) for i in range(len(chosen))]
        children = np.arange(len(pages), len(pages) + len(chosen))
        pages += [None] * len(chosen)
        pages[number] = False, chosen, children, distances(sphere[chosen], point[None])[:, 0], np.array([d[p, i].max() for i, p in enumerate(parts)])
        todo += [(c, rows[p], sphere[i]) for c, p, i in zip(children.tolist(), parts, chosen, strict=True)]
    return pages


class Subtree:
    """Pages in memory, and walks over them."""

    def __init__(self, pages: pa.Table, space: Space):
        self.space, self.pages = space, {}
        for page, leaf, child, ids, x, to_parent, radius in zip(*(pages[c].to_pylist() for c in ("page", "leaf", "child", "id", "x", "to_parent", "radius")), strict=True):
            flat = np.array(x, np.int64).reshape(len(child), space.dim)
            self.pages[page] = leaf, np.array(child, np.int64), ids, flat.astype(np.float64) if space.plain else flat, np.array(to_parent), np.array(radius)

    def walk(self, pos: int, q: np.ndarray, to_top: float, k: int, bound: int | None) -> tuple[list[tuple[int, int | None, int]], int]:
        """The best (score, id, pos) for the query ``q`` that are not below ``bound``, at most k and those that tie; how many products were computed. ``to_top``: the distance to the pivot."""
        space, q = self.space, q.astype(np.float64) if self.space.plain else q
        reach = float((q.astype(np.float64) ** 2).sum()) + space.most
        slack = space.slack + 1e-6 * reach**0.5
        far = lambda score: max(0.0, reach - 2.0 * score) ** 0.5 + slack
        worst = far(bound) if bound is not None else np.inf
        best: list[tuple[int, int | None, int]] = []
        computed, heap = 0, [(0.0, 0, to_top)] if self.pages else []
        while heap and heap[0][0] <= worst:
            _, number, to_point = heappop(heap)
            leaf, child, ids, x, to_parent, radius = self.pages[number]
            near = np.flatnonzero(np.abs(to_point - to_parent) - radius <= worst)
            computed += len(near)
            score = x[near] @ q if space.plain else products(x[near], q[None], False)[:, 0]
            if not leaf:
                d = np.sqrt(np.maximum(reach - 2.0 * score.astype(np.float64), 0))
                least = d - radius[near]
                for i in np.flatnonzero(least <= worst):
                    heappush(heap, (max(0.0, float(least[i])), int(child[near[i]]), float(d[i])))
                continue
            floor = bound if bound is not None else -np.inf
            found = [(int(score[i]), ids[near[i]], int(child[near[i]])) for i in np.flatnonzero(score >= floor) if child[near[i]] != pos]
            if found:
                best = sorted(best + found, key=lambda b: (-b[0], b[1] is None, b[1] or 0, b[2]))[:k]
                if len(best) == k:
                    bound = best[-1][0]
                    worst = far(bound)
        return best, computed


def tree_pages(table: DataFrame, at: np.ndarray, space: Space, tree_rows: int = TREE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The pages of all subtrees, and cell, slice, radius of each: two written tables. Every point is in one leaf."""
    placed = written(nearest(table, at, space), "placed")
    sizes = dict(placed.groupBy("cell").count().collect())  # a row a pivot
    slices = F.array(*(F.lit(max(1, -(-sizes.get(i, 0) // tree_rows))) for i in range(len(at))))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("pos"), F.get(slices, F.col("cell"))).cast("int"))
    dim, most = space.dim, space.most

    def build(key, rows):
        x = matrix(rows["x"], dim)
        pos, ids = rows["pos"].to_numpy(), np.array(rows["id"].to_pylist(), object)
        pages = pages_of(x, on_sphere(x, most), at[key[0].as_py()])
        out = [(number, leaf, pos[child] if leaf else child, ids[entries] if leaf else [], x[entries].ravel(), to_parent, radius) for number, (leaf, entries, child, to_parent, radius) in enumerate(pages)]
        kinds = [pa.int32(), pa.bool_(), *map(pa.list_, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        cells = [pa.array([k.as_py()] * len(out), pa.int32()) for k in key]
        return pa.table([*cells, *(pa.array([list(v) if i > 1 else v for v in c], kind) for i, (c, kind) in enumerate(zip(zip(*out, strict=True), kinds, strict=True)))], names=["cell", "slice", "page", "leaf", "child", "id", "x", "to_parent", "radius"])

    pages = placed.select("cell", "slice", "pos", "id", "x").groupBy("cell", "slice").applyInArrow(build, PAGES)
    return written(pages, "pages"), written(placed.groupBy("cell", "slice").agg(F.max("d").alias("radius")), "trees")


def _walks(asked: DataFrame, pages: DataFrame, space: Space, k: int) -> DataFrame:
    """The k best of each asked subtree: query, id, pos, score, computed. ``asked``: query, q, cell, slice, block, to_top, bound."""
    dim = space.dim

    def search(queries, held):
        tree = Subtree(held, space)
        q, out = matrix(queries["q"], dim), []
        for row, (query, to_top, bound) in enumerate(zip(*(queries[c].to_pylist() for c in ("query", "to_top", "bound")), strict=True)):
            best, computed = tree.walk(query, q[row], to_top, k, bound)
            out += [(query, i, p, s, computed if n == 0 else 0) for n, (s, i, p) in enumerate(best or [(None, None, None)])]
        columns = zip(*out, strict=True)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "id", "pos", "score", "computed"])

    key = ["cell", "slice", "block"]
    wanted = asked.select("cell", "slice", F.col("block").alias("for_block")).distinct()
    sent = pages.join(wanted, ["cell", "slice"]).select(F.col("cell").alias("of_cell"), F.col("slice").alias("of_slice"), "for_block", *pages.columns[2:])
    return asked.groupBy(*key).cogroup(sent.groupBy("of_cell", "of_slice", "for_block")).applyInArrow(search, "query long, id long, pos long, score long, computed long")


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 1024, roots: int | None = None, tree_rows: int = TREE_ROWS) -> DataFrame:
    """The ``k`` rows with the highest inner products for each row where ``is_query``: query_id, rank (from 1), the row's id, score; all, if fewer.

    Components v become floor(factor * v). All rows but the query's own are its candidates, whether their ids
    repeat or not; a row whose id repeats has its own ranks. Equal scores are in order of their ids, a null id last;
    a null ``is_query`` is false. Vectors that are null or have a null or non-finite component take no part,
    missing components count as 0. Tables without rows or queries give an empty result. Other columns are not read.
    The last column, computed, is how many products of the query were computed, the others having been ruled out by bounds.
    """
    table, space = points(rows, id_col, vector_col, factor, asks=F.coalesce(is_query, F.lit(False)))
    kind = rows.schema[id_col].dataType
    empty = rows.sparkSession.createDataFrame([], f"query_id {kind.simpleString()}, rank int, {id_col} {kind.simpleString()}, score long, computed long")
    queries = table.where("asks")
    n = queries.count()
    if not n:
        return empty
    at = pivots(table, space, min(ROOTS, roots or -(-space.rows // tree_rows)))
    pages, trees = tree_pages(table.select("pos", F.col("id").cast("long").alias("id"), "x"), at, space, tree_rows)
    reach = dict(trees.groupBy("cell").agg(F.max("radius")).collect())  # a row a pivot
    radius = np.array([reach.get(i, -np.inf) for i in range(len(at))])
    blocks = -(-n // BLOCK)
    asked = queries.select(F.col("pos").alias("query"), F.col("x").alias("q"), F.pmod(F.xxhash64("pos"), F.lit(blocks)).cast("int").alias("block"))

    def sent(source: DataFrame, first: bool) -> DataFrame:
        """The cells to be asked: the most promising one, or all that may hold what the bound asks for."""
        dim, most = space.dim, space.most

        def each(batches):
            for batch in batches:
                x = matrix(batch.column(1), dim)
                to_top = distances(as_queries(x), at)
                least = np.maximum(to_top - radius, 0)
                if first:
                    query, cell = np.arange(len(x)), (least + 1e-9 * to_top).argmin(1)
                else:
                    bound = np.array([-np.inf if b is None else b for b in batch.column(3).to_pylist()], float).reshape(-1)
                    square = (x.astype(float) ** 2).sum(1) + most
                    worst = np.sqrt(np.maximum(square - 2 * bound, 0)) + space.slack + 1e-6 * np.sqrt(square)
                    query, cell = np.nonzero(least <= worst[:, None])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(query)) for c in batch.columns), pa.array(cell, pa.int32()), pa.array(to_top[query, cell])], names=[*batch.schema.names, "cell", "to_top"])

        return source.mapInArrow(each, StructType([*source.schema.fields, StructField("cell", IntegerType()), StructField("to_top", DoubleType())]))

    first = sent(asked, True).withColumns({"slice": F.lit(0), "bound": F.lit(None).cast("long")})
    home = written(_walks(first, pages, space, k), "first-walks")
    bounds = home.groupBy("query").agg(F.count("score").alias("n"), F.min("score").alias("least")).select("query", F.when(F.col("n") >= k, F.col("least")).alias("bound"))
    homes = first.select("query", F.col("cell").alias("home"))
    again = sent(asked.join(bounds, "query", "left").select("query", "q", "block", "bound"), False).join(homes, "query").join(trees, "cell")
    square = F.aggregate("q", F.lit(space.most), lambda t, v: t + v.cast("double") * v.cast("double"))
    worst = F.sqrt(F.greatest(square - 2 * F.col("bound"), F.lit(0.0))) + F.lit(space.slack) + F.lit(1e-6) * F.sqrt(square)
    others = again.where(~((F.col("cell") == F.col("home")) & (F.col("slice") == 0)) & (F.col("bound").isNull() | (F.col("to_top") - F.col("radius") <= worst)))
    found = home.unionByName(_walks(others.select("query", "q", "block", "bound", "cell", "to_top", "slice"), pages, space, k))
    computed = found.groupBy("query").agg(F.sum("computed").alias("computed"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "pos")
    best = found.where("score IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = queries.select(F.col("pos").alias("query"), F.col("id").alias("query_id"))
    return best.drop("computed").join(named, "query").join(computed, "query").select("query_id", "rank", F.col("id").cast(kind).alias(id_col), "score", "computed")
