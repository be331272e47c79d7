"""Vectors as integer points, and inner products as distances.

A point's components are whole numbers, so inner products are exact. With one more coordinate,
sqrt(M - |x|^2) for a point (M: the greatest squared length) and 0 for a query, all points lie on one
sphere and the squared distance from query to point is |q|^2 + M - 2 q.x: the higher the product the
smaller the distance, and the triangle inequality holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..scratch import written

#: Distances are rounded numbers; bounds give way by this share of the numbers they are made of.
SLACK = 1e-6
LONGS = np.iinfo(np.int64)


@dataclass(frozen=True)
class Space:
    """What all points have in common: their number, the longest vector's components, the greatest squared length and component."""

    rows: int
    dim: int
    most: float
    largest: float

    @property
    def plain(self) -> bool:
        """True if doubles hold every product exactly."""
        return self.largest**2 * max(self.dim, 1) < 2**53

    @property
    def slack(self) -> float:
        return SLACK * (1 + 2 * self.most**0.5)


def points(rows: DataFrame, id_col: str, vector_col: str, factor: int, **more: Column) -> tuple[DataFrame, Space]:
    """A written table pos (a number of its own for each row), id, x (whole numbers), ``more``; and its space.

    A component v becomes floor(factor * v), held at the ends of 64 bits. A vector that is null or has a
    null or non-finite component takes no part. Missing components of shorter vectors count as 0.
    """
    vector = F.col(vector_col)
    whole = F.coalesce(F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    x = F.transform(vector, lambda v: F.floor(F.lit(factor) * v.cast("double")))
    table = written(rows.where(whole).select(F.monotonically_increasing_id().alias("pos"), F.col(id_col).alias("id"), x.alias("x"), *(c.alias(n) for n, c in more.items())), "points")
    square = F.aggregate("x", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
    size = F.aggregate("x", F.lit(0.0), lambda t, v: F.greatest(t, F.abs(v.cast("double"))))
    n, dim, most, largest = table.agg(F.count("*"), F.max(F.size("x")), F.max(square), F.max(size)).first()
    return table, Space(n, dim or 0, most or 0.0, largest or 0.0)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A column of lists of whole numbers as rows of ``dim`` numbers, the missing ones 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, plain: bool) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``; beyond 64 bits they are held at its ends."""
    if plain:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, LONGS.min, LONGS.max).astype(np.int64) if exact.size else exact.astype(np.int64)


def on_sphere(x: np.ndarray, most: float) -> np.ndarray:
    """Points with their further coordinate."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def as_queries(x: np.ndarray) -> np.ndarray:
    """Queries with their further coordinate, 0."""
    return np.hstack([x.astype(np.float64), np.zeros((len(x), 1))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of ``a`` and of ``b``, with an error below a slack."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def spread_out(x: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """Indexes of at most ``n`` distinct rows of ``x``, each the farthest from those before it."""
    if not len(x):
        return np.zeros(0, np.int64)
    out = [int(np.random.default_rng(seed).integers(len(x)))]
    near = distances(x, x[out])[:, 0]
    while len(out) < n and near.max() > SLACK * (1 + np.abs(x).max()):
        out.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[out[-1:]])[:, 0])
    return np.array(out)


def pivots(table: DataFrame, space: Space, n: int, sample: int = 4096) -> np.ndarray:
    """At most ``n`` points, far from one another, out of the ``sample`` points with the least hashes, on the sphere."""
    hashed = table.select("x", F.pmod(F.xxhash64("pos", F.lit("pivots")), F.lit(1 << 32)).alias("h"))
    # about twice the sample is left, however many rows and tasks there are
    rows = hashed.where(F.col("h") < (1 << 33) * sample // max(space.rows, 1)).orderBy("h").limit(sample).select("x").toArrow()
    x = on_sphere(matrix(rows["x"], space.dim), space.most)
    return x[spread_out(x, n)]


def nearest(table: DataFrame, at: np.ndarray, space: Space) -> DataFrame:
    """Adds cell (the number of the nearest pivot) and d (the distance to it) to points. ``table`` has x."""
    kind = StructType([*table.schema.fields, StructField("cell", IntegerType()), StructField("d", DoubleType())])
    dim, most = space.dim, space.most

    def each(batches):
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("x")), dim)
            d = distances(on_sphere(x, most), at)
            cell = d.argmin(1) if d.size else np.zeros(len(x), np.int64)
            found = [pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "cell", "d"])

    return table.mapInArrow(each, kind)
