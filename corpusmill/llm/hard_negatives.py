"""Hard negatives for embedding training: a distributed kNN join over a Voronoi partition.

Inner products become distances by one more coordinate (see ``metric``). Pivots, far-apart points of a
bounded sample, cut the space into cells; every row knows its cell and its distance to the pivot. Anchors
of neighbouring cells form groups. What an anchor asks for lies within a range of distances from it: for
positives up to an upper bound of its k-th nearest row of the same label, which the nearest rows of each
cell and label give; for negatives within the window of allowed scores. By the triangle inequality that
range becomes, for each group and cell, a range of distances to the cell's pivot, and a row is sent only
to the groups whose range holds its own. There blocks of anchors meet slices of rows, both of a bounded
size, and all products are computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .folds import clear_name
from .metric import SLACK, Space, as_queries, distances, matrix, nearest, pivots, points, products, spread_out

#: Pivots; anchors in a block (and in a group, about), rows in a slice.
PIVOTS, BLOCK, SLICE = 32, 1024, 8192


def _to_pivots(anchors: DataFrame, at: np.ndarray, space: Space) -> DataFrame:
    """Adds to_pivot: the distances of an anchor to all pivots. ``anchors``: x at last."""
    dim = space.dim

    def each(batches):
        for batch in batches:
            d = distances(as_queries(matrix(batch.column(batch.num_columns - 1), dim)), at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64()))], names=[*batch.schema.names, "to_pivot"])

    fields = ", ".join(f"`{n}` {t}" for n, t in anchors.dtypes)
    return anchors.mapInArrow(each, f"{fields}, to_pivot array<double>")


def grouped(anchors: DataFrame, at: np.ndarray) -> DataFrame:
    """Adds grp: the group of the anchor's nearest pivot. Pivots are grouped around as many far-apart ones as there are blocks of anchors."""
    cell = F.array_position("to_pivot", F.array_min("to_pivot")).cast("int") - 1
    groups = min(len(at), -(-anchors.count() // BLOCK))
    seeds = at[spread_out(at, groups)]
    of_cell = distances(at, seeds).argmin(1) if len(seeds) else []
    return anchors.withColumn("grp", F.get(F.array(*(F.lit(int(g)) for g in of_cell)), cell))


def _ranges(anchors: DataFrame, keys: list[str], nearest_: Column, farthest: Column, slack: float) -> DataFrame:
    """keys, cell, lo, hi: the distances to each cell's pivot at which rows may lie between ``nearest_`` and ``farthest`` of an anchor."""
    spread = anchors.select(*keys, nearest_.alias("_near"), farthest.alias("_far"), F.posexplode("to_pivot").alias("cell", "_d"))
    lo = F.greatest(F.col("_d") - F.col("_far"), F.col("_near") - F.col("_d")) - slack
    return spread.groupBy(*keys, "cell").agg(F.min(lo).alias("lo"), F.max(F.col("_d") + F.col("_far") + slack).alias("hi"))


def _served(placed: DataFrame, ranges: DataFrame, anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors by keys, block and slice: each row is copied to the groups that it may serve, each anchor meets every slice of its group's rows once."""
    by = ["cell", *(k for k in keys if k != "grp")]
    ranges = written(ranges, "ranges")
    may = placed.join(ranges, by).where((F.col("d") >= F.col("lo")) & (F.col("d") <= F.col("hi"))).drop("lo", "hi")
    # how many blocks and slices each group has, from counts
    sizes = anchors.groupBy(*keys).agg(F.count("*").alias("n")).join(may.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    sizes = written(sizes.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("m") / SLICE).cast("int").alias("slices")), "sizes")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c: F.pmod(F.xxhash64("pos"), F.col(c)).cast("int")
    rows = may.join(sizes, keys).withColumn("slice", place("slices")).withColumn("block", upto("blocks")).drop("blocks", "slices", "cell", "d")
    asks = anchors.join(sizes, keys).withColumn("block", place("blocks")).withColumn("slice", upto("slices")).drop("blocks", "slices", "to_pivot")
    return rows, asks


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows in the order of equal scores: ids, a null one last, then places."""
    ids = rows["id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, i))
    return rows.take(pa.array(order, pa.int64()))


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Labels as numbers, equal ones alike."""
    known: dict = {}
    return [np.array([known.setdefault(v, len(known)) for v in c.to_pylist()], np.int64) for c in columns]


def _join(asks: DataFrame, rows: DataFrame, keys: list[str], search, schema: str) -> DataFrame:
    """``search(anchors, rows)`` for each block of anchors and slice of rows, an empty side left out."""
    apart = rows.select(*(F.col(k).alias(f"{k}_of") for k in keys), *(c for c in rows.columns if c not in keys))
    kinds = pa.schema([(n, pa.int64()) for n in schema.replace(" long", "").split(", ")])

    def each(left, right):
        found = search(left, _in_order(right)) if len(left) and len(right) else []
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(kinds), schema=kinds)

    return asks.groupBy(*keys).cogroup(apart.groupBy(*(f"{k}_of" for k in keys))).applyInArrow(each, schema)


def positives_of(placed: DataFrame, anchors: DataFrame, at: np.ndarray, space: Space, k: int) -> DataFrame:
    """The ``k`` other rows of the same label with the highest scores for each anchor: anchor (its pos), pos, id, score."""
    # the k + 1 rows next to the pivot in each cell and label bound the k-th nearest other row of any anchor
    near = Window.partitionBy("cell", "label").orderBy("d", "pos")
    firsts = placed.select("cell", "label", "d", "pos").withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    firsts = written(firsts.groupBy("label").agg(F.collect_list(F.struct("cell", "d")).alias("firsts")), "firsts")  # pivots * (k + 1) entries
    bound = F.get(F.array_sort(F.transform("firsts", lambda f: F.get("to_pivot", f["cell"]) + f["d"])), F.lit(k))
    bounded = anchors.join(firsts, "label").withColumn("_bound", F.coalesce(bound, F.lit(float("inf"))))
    ranges = _ranges(bounded, ["grp", "label"], F.lit(0.0), F.col("_bound"), space.slack)
    rows, asks = _served(placed.drop("anchor"), ranges, anchors, ["grp", "label"])
    dim, plain = space.dim, space.plain

    def search(left, right):
        a, c = matrix(left["x"], dim), matrix(right["x"], dim)
        who, pos, ids = left["pos"].to_numpy(), right["pos"].to_numpy(), right["id"].to_pylist()
        out = []
        for i in range(0, len(a), 256):
            scores = products(a[i : i + 256], c, plain)
            for row, own in zip(scores, who[i : i + 256], strict=True):
                least = np.partition(row, -k - 1)[-k - 1] if len(row) > k else row.min()
                best = np.flatnonzero((row >= least) & (pos != own))
                best = best[np.argsort(~row[best], kind="stable")]  # ~s falls as s rises, without an overflow
                out += [(int(own), int(pos[j]), ids[j], int(row[j])) for j in best[:k]]
        return out

    found = _join(asks, rows, ["grp", "label", "block", "slice"], search, "anchor long, pos long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "pos")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def negatives_of(placed: DataFrame, anchors: DataFrame, at: np.ndarray, space: Space, k: int) -> DataFrame:
    """The ``k`` highest-scoring rows of other labels within each window of each anchor: anchor, nth (window), pos, id, score. ``anchors`` have windows: array of (nth, lo, hi)."""
    square = F.aggregate("x", F.lit(space.most), lambda t, v: t + v.cast("double") * v.cast("double"))
    at_score = lambda s: F.sqrt(F.greatest(square - 2.0 * s, F.lit(0.0)))
    # the error of a distance grows with the anchor's length
    give = F.lit(SLACK) * F.sqrt(square)
    nearest_ = at_score(F.array_max(F.transform("windows", lambda w: w["hi"]))) - give
    farthest = at_score(F.array_min(F.transform("windows", lambda w: w["lo"]))) + give
    ranges = _ranges(anchors, ["grp"], nearest_, farthest, space.slack)
    rows, asks = _served(placed.drop("anchor"), ranges, anchors, ["grp"])
    dim, plain = space.dim, space.plain

    def search(left, right):
        a, c = matrix(left["x"], dim), matrix(right["x"], dim)
        who, windows, pos, ids = left["pos"].to_pylist(), left["windows"].to_pylist(), right["pos"].to_numpy(), right["id"].to_pylist()
        own, other = _codes(left["label"], right["label"])
        out = []
        for i in range(0, len(a), 256):
            for n, row in enumerate(products(a[i : i + 256], c, plain), i):
                asked = windows[n]
                fit = np.flatnonzero((row >= min(w["lo"] for w in asked)) & (row <= max(w["hi"] for w in asked)) & (other != own[n]))
                fit = fit[np.argsort(~row[fit], kind="stable")]
                falling = ~row[fit]
                for w in asked:
                    first = np.searchsorted(falling, ~np.int64(w["hi"]))
                    out += [(who[n], w["nth"], int(pos[j]), ids[j], int(row[j])) for j in fit[first : first + k] if row[j] >= w["lo"]]
        return out

    found = _join(asks, rows, ["grp", "block", "slice"], search, "anchor long, nth long, pos long, id long, score long")
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), F.asc_nulls_last("id"), "pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, cells: int = PIVOTS
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose scores are ``low`` to ``high`` hundredths of the positive's.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Scores are inner
    products of floor(factor * v); higher ones come first, equal ones in order of their ids, a null id last. An
    anchor is no positive of itself, but another row of its id may be. Rows without a label, and vectors that are
    null or have a null or non-finite component, take no part; missing components of shorter vectors count as 0; a
    null ``is_anchor`` is false. An anchor without positives, or a positive without such rows, gives no row, and an
    empty table an empty result. Other columns are not read. Ids are whole numbers.
    """
    own = clear_name("_label", rows.columns)
    kept = rows.withColumn(own, label.cast("string")).where(F.col(own).isNotNull())
    table, space = points(kept, id_col, vector_col, factor, label=F.col(own), anchor=F.coalesce(is_anchor, F.lit(False)))
    kind = rows.schema[id_col].dataType.simpleString()
    names = [("anchor_id", kind), ("positive_id", kind), ("rank", "int"), ("negative_id", kind), ("positive_score", "long"), ("negative_score", "long")]
    table = table.withColumn("id", F.col("id").cast("long"))
    asked = table.where("anchor").select("pos", "label", "x")
    if asked.isEmpty():
        return rows.sparkSession.createDataFrame([], ", ".join(f"{n} {k}" for n, k in names))
    at = pivots(table, space, cells)
    placed = written(nearest(table, at, space), "placed")
    anchors = written(grouped(_to_pivots(asked, at, space), at), "anchors")
    best = written(positives_of(placed, anchors, at, space, positives), "positives")
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "pos"))
    best = best.withColumn("nth", nth)
    # whole numbers: the least score with 100 s >= low p, the greatest with 100 s <= high p
    hundredth = lambda n: F.expr(f"CAST(floor(CAST(score AS DECIMAL(38, 0)) * {n} / 100) AS LONG)")
    window = F.struct("nth", (-F.expr(f"CAST(floor(CAST(-score AS DECIMAL(38, 0)) * {low} / 100) AS LONG)")).alias("lo"), hundredth(high).alias("hi"))
    windows = best.withColumn("w", window).where("w.lo <= w.hi").groupBy(F.col("anchor").alias("pos")).agg(F.collect_list("w").alias("windows"))
    asks = written(anchors.join(windows, "pos"), "windows")
    found = negatives_of(placed, asks, at, space, negatives)
    told = found.select("anchor", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = told.join(best.select("anchor", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "nth"])
    ids = table.where("anchor").select(F.col("pos").alias("anchor"), F.col("id").alias("anchor_id"))
    return told.join(ids, "anchor").select(*(F.col(n).cast(k) for n, k in names))
