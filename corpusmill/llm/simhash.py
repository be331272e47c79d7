"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into ``segments`` equal segments; the vector of their bit counts moves
by at most one unit, in Manhattan distance, for each bit that differs. So fingerprints within two
bits have vectors within distance two, and then some grid point lies within one unit of both. The
range join is an equi-join on grid points: each distinct fingerprint goes to its own point and its
neighbours (49 on average for 32 segments), and points that hold one fingerprint only drop out.

What is left is verified exactly, again without pairs: each fingerprint goes to the 65 points of
Hamming distance one or less around it. Two fingerprints that share such a point differ in two bits
at most, and any two that differ in two bits or fewer share one; so linking every fingerprint of a
point to the least one there gives exactly the components of the links, however many near copies
crowd together. Work and rows are linear in the distinct fingerprints.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..scratch import written
from .components import components
from .folds import clear_name

#: Bits by which linked fingerprints differ at most: the verification by shared points is exact for this number.
LINKED_BITS = 2


def simhash(text: str | None, shingle_words: int, seed: int = 42) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    hashes = np.array(list(map(xxh64_intdigest, shingles, repeat(seed))), ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """id, fp: words are runs without ASCII white space, A-Z lower-cased; repeats count.

    A text of fewer words than a shingle is one shingle; null, empty and blank texts have fingerprint 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash(t, shingle_words) for t in batch.column(1).to_pylist()], pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(each, f"id {kind}, fp long")


def grid_points(fp: Column, segments: int = 32) -> Column:
    """The packed popcount vector of a fingerprint and the vectors at Manhattan distance one.

    More segments tell more fingerprints apart at the price of more neighbours: with 16, chance
    neighbours among n fingerprints outgrow n from some 10**5 on, with 32 from some 10**9 on.
    """
    width = 64 // segments
    bits = (width + 1).bit_length()
    counts = [F.bit_count(F.shiftright(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for i in range(segments)]
    own = F.shiftleft(counts[0], 0)
    for i, c in enumerate(counts[1:], 1):
        own = own.bitwiseOR(F.shiftleft(c, bits * i))
    # a step replaces one count by its neighbour; the highest count may fill the sign bit, so nothing is added
    steps = [F.lit(0).cast("long")]
    for i, c in enumerate(counts):
        steps += [F.when(c < width, F.shiftleft(c.bitwiseXOR(c + 1), bits * i)), F.when(c > 0, F.shiftleft(c.bitwiseXOR(c - 1), bits * i))]
    # the vector is bound once, not once for each step
    return F.flatten(F.transform(F.array(own), lambda at: F.transform(F.array_compact(F.array(*steps)), lambda step: at.bitwiseXOR(step))))


def ball_points(fp: Column) -> Column:
    """The fingerprints at Hamming distance one or less."""
    flips = [0, *(1 << i for i in range(63)), -(1 << 63)]
    return F.transform(F.array(*(F.lit(x).cast("long") for x in flips)), lambda flip: fp.bitwiseXOR(flip))


def _crowded(points: DataFrame) -> DataFrame:
    """fp and the least fp of its point, for points that hold two or more."""
    held = points.groupBy("point").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most")
    # written, since a join with an aggregate by the same key cannot be split where a point is crowded; the same
    # plan at every size: how many points are held grows with the corpus
    held = written(held.select("point", "least"), "points")
    return points.join(held.hint("merge"), "point").select("fp", "least")


def linked(distinct: DataFrame, segments: int = 32) -> DataFrame:
    """Links a > b that connect exactly the fingerprints connected by pairs within two bits. ``distinct``: fp, each once."""
    # a few bytes become many rows: as few as they are they would all be in a task or two, so they are dealt
    # out anew, by a hash, since an exchange by fp itself would count as done
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    near = _crowded(spread.select("fp", F.explode(grid_points(F.col("fp"), segments)).alias("point"))).select("fp").distinct()
    exact = _crowded(near.select("fp", F.explode(ball_points(F.col("fp"))).alias("point")))
    return exact.where("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, segments: int = 32) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Repeated rows are returned each; a null id is never a component's smallest unless all its ids are
    null. Equal texts, and all texts without words, share a component. An empty table gives an empty
    result; other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(linked(distinct, segments))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = placed.join(least, "root").select("fp", "component_id")
    out = prints.join(placed, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, segments: int = 32) -> DataFrame:
    """One row of each group of near duplicates with all its columns: that with the smallest id, the first read of equals.

    A null id comes before all others. Rows are told apart by their place in ``docs``, which is read
    twice and must give the same rows in the same order: a scan of files.
    """
    own = clear_name("_row", docs.columns)
    placed = docs.withColumn(own, F.monotonically_increasing_id())
    keyed = placed.select(F.struct(F.col(id_col).alias("id"), F.col(own).alias("row")).alias("_key"), F.col(text_col).alias("_text"))
    groups = near_duplicates(keyed, "_key", "_text", shingle_words, segments)
    firsts = groups.where("_key = component_id").select(F.col("_key.row").alias(own))
    return placed.join(firsts, own, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
