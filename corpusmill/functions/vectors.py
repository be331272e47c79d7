"""Vector functions over ARRAY<FLOAT> as Column expressions; arithmetic is in doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def sign_histogram(text: Column, dim: int = 64) -> Column:
    """The offline embedding: how many signs have each code point modulo ``dim``, scaled to length 1; zeros for no text.

    It stands where a model would, so it is a batch function over Arrow like one.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            n = np.bincount(np.frombuffer((t or "").encode("utf-32-le"), np.uint32) % dim, minlength=dim).astype(float)
            return (n / max(np.linalg.norm(n), 1e-12)).astype(np.float32)

        return texts.map(one, na_action=None)

    return embed(text)
