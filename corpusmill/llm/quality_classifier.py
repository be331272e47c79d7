"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text: its distinct words, runs of other characters and pairs of neighbours, hashed to
``2 ** bits`` columns, each with weight 1 / sqrt(number of distinct features). All pairs of equal
neighbours share one column. Training takes a bounded sample of the labelled rows (``sample_rows``),
dealt to at most ``shards`` workers that each run the FTRL-proximal updates over their rows in the
order of a hash, both classes with the same total weight. A worker scales its model so that a score
is the probability of label 1 among equally many rows of both classes: slope and offset are fitted to
scores of rows that models trained without them give. The scaled weights are averaged, so the model is
2 ** bits numbers whatever the corpus. A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import bounded_sample

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Token -> 32-bit hash, up to ``most`` tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[token] = h = crc32(token.encode())
        return h


_HASHES = _Hashes()


def features(text: str | None, bits: int) -> np.ndarray:
    """The distinct columns of a text; none for null and blank texts."""
    tokens = _TOKEN.findall(text or "")
    one = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    two[one[:-1] == one[1:]] = np.uint64(0xD6E8FEB86659FD93)
    one = one * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(np.concatenate([one, two]) >> np.uint64(64 - bits)).astype(np.int64)


def dot(weights: np.ndarray, columns: np.ndarray) -> float:
    """The sparse dot product of a text's columns, and the bias."""
    return weights[columns].sum() / np.sqrt(max(len(columns), 1)) + weights[-1]


def ftrl(rows, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights (the last is the bias) after ``epochs`` passes over [(columns, label)], both classes weighted alike in sum."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    ones = sum(label > 0.5 for _, label in rows)
    share = {True: len(rows) / (2 * ones or 1), False: len(rows) / (2 * (len(rows) - ones) or 1)}
    for _ in range(epochs):
        for columns, label in rows:
            at = np.append(columns, size - 1)
            x = np.append(np.full(len(columns), 1 / np.sqrt(max(len(columns), 1))), 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x * share[label > 0.5]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] += g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def scale(margins: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on margins, both classes weighted alike; (1, 0) if one is missing."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    if not ones or not zeros:
        return 1.0, 0.0
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / zeros)
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))  # no class is ever certain
    x, fit, pull = np.stack([margins, np.ones_like(margins)], 1), np.zeros(2), np.array([ridge, 1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -35, 35)))
        fit -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(pull), x.T @ (weight * (p - target)) + pull * fit)
    return float(fit[0]), float(fit[1])


def fitted(rows, bits: int, folds: int, **settings) -> np.ndarray:
    """The weights of all rows, scaled by the margins that ``folds`` models give to the rows they have not seen."""
    margins, labels = np.zeros(len(rows)), np.array([float(label > 0.5) for _, label in rows])
    for k in range(folds):
        w = ftrl([r for i, r in enumerate(rows) if i % folds != k], bits, **settings)
        for i in range(k, len(rows), folds):
            margins[i] = dot(w, rows[i][0])
    slope, offset = scale(margins, labels)
    w = ftrl(rows, bits, **settings) * slope
    w[-1] += offset
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = 24_000, shards: int = 4, shard_rows: int = 2_000, bits: int = 18, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 4, folds: int = 5) -> np.ndarray:
    """Weights averaged over the shards, as many as have ``shard_rows`` rows each, one at least.

    The margins of each are scaled by those that ``folds`` models, at every size as many, give to rows they have not seen.

    Rows without an id or label are left out; without rows all weights are 0. An id that repeats in
    ``docs`` or ``labels`` counts once for each pair; rows stand in the order of a hash of the id, ties
    in that of label and columns. Whole texts are hashed where they are read, so a worker that trains
    gets columns only, at most 2 ** bits a text however long. The sample is drawn from ``labels``, so it
    is small enough to broadcast and the texts are not shuffled for it.
    """
    drawn = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label"))
    drawn = bounded_sample(drawn, "_id", sample_rows)
    shards = max(1, min(shards, drawn.count() // shard_rows))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "_id").select(F.xxhash64(F.col("_id").cast("string"), F.lit("order")).alias("at"), "text", "label")

    def hashed(batches):
        for batch in batches:
            columns = [features(t, bits).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(columns, pa.list_(pa.int32()))], names=["at", "label", "columns"])

    dealt = rows.mapInArrow(hashed, "at long, label double, columns array<int>").withColumn("shard", F.pmod("at", F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "at", "label", "columns")

    def fit(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            for label, columns, shard in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                kept.setdefault(shard, []).append((columns.values.to_numpy().astype(np.int64), label))
        for shard, own in kept.items():
            w = fitted(own, bits, folds, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(at), pa.array(w[at])], names=["shard", "i", "w"])

    weights = np.zeros((1 << bits) + 1)
    found = dealt.mapInArrow(fit, "shard long, i long, w double").toPandas()  # at most shards * 2 ** bits rows
    if len(found):
        found = found.sort_values(["shard", "i"])
        np.add.at(weights, found["i"].to_numpy(), found["w"].to_numpy())
        weights /= found["shard"].nunique()
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every whole text: 0 to 1, higher the likelier label 1 is.

    Null, empty and blank texts score by the bias alone; repeated rows and null ids stay; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** bits numbers
    bits, kind = int(len(weights)).bit_length() - 1, docs.schema[id_col].dataType.simpleString()

    def each(batches):
        w = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                out.append(1 / (1 + np.exp(-dot(w, features(text, bits)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(each, f"id {kind}, score double").withColumnRenamed("id", id_col)
