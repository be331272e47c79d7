"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds the pieces of more than
``capacity / (k + 1)`` and at most ``capacity / k`` tokens, and each of its bins takes exactly k of
them, so a bin needs no search and no state shared between workers: the piece with rank r in its
class goes to bin ``r // k``. Documents may be cut, so a document is cut at class borders until each
piece nearly fills its slot; the class then wastes little. The ranks come from a window over
(class, bucket), buckets being hashes of the document, and from the counts of those groups: a table
of at most 2 * sqrt(capacity) classes times the buckets.

Each class has at most one bin that is not full. Their pieces, fewer than k a class and so bounded
by the capacity alone (under 12,000 for 2048), are packed together, longest first.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pretokens import chunk_ids
from ..scratch import written


def cuts(n: int, capacity: int, slack: float = 0.02) -> list[int]:
    """Lengths of the pieces of n tokens: whole sequences, then pieces that leave at most ``slack`` of their slot free."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        slot = capacity // (capacity // n)
        if slot - n <= max(1, slack * slot):
            out.append(n)
            break
        out.append(capacity // (capacity // n + 1))
        n -= out[-1]
    return out


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """The pieces of every document's ids: id, start, length, doc_tokens, ids_crc32, and ids (little-endian uint32) if ``keep_ids``.

    A null or empty text is the end id alone. Rows with equal ids stay separate documents, told
    apart by ``row`` (a number of their own, stable for a stable input). Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "row", "start", "length", "doc_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]

    def pieces(batches):
        ids, end = chunk_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, starts, lengths, totals, crcs, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own, start = ids.ids(text) + end, 0
                for n in cuts(len(own) // 4, capacity):
                    piece = own[4 * start : 4 * (start + n)]
                    at.append(i)
                    starts.append(start)
                    lengths.append(n)
                    totals.append(len(own) // 4)
                    crcs.append(crc32(piece))
                    if keep_ids:
                        kept.append(piece)
                    start += n
            take = pa.array(at, pa.int64())
            longs = [pa.array(x, pa.int64()) for x in (starts, lengths, totals, crcs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), *longs, *([pa.array(kept, pa.binary())] if keep_ids else [])], names=names)

    rows = docs.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(pieces, f"id {kind}, row long, start long, length long, doc_tokens long, ids_crc32 long" + ", ids binary" * keep_ids).withColumnRenamed("id", id_col)


def _fill(capacity: int):
    """First-fit decreasing of the few pieces that full bins left over."""

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("start", "ascending")])
        free, bins, offsets = np.zeros(0, np.int64), [], []
        for n in table["length"].to_pylist():
            fits = np.flatnonzero(free >= n)
            if not len(fits):
                free, fits = np.append(free, capacity), [len(free)]
            bins.append(int(fits[0]))
            offsets.append(int(capacity - free[fits[0]]))
            free[fits[0]] -= n
        return table.append_column("bin", pa.array(bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return fill


def harmonic_pack(pieces: DataFrame, capacity: int = 2048, buckets: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces that have row, start and length; keeps all their columns.

    ``pieces`` is read three times: give a table, not a costly plan. Lengths are 1 to ``capacity``.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in pieces.columns if c not in ("_k", "_bucket")]
    dealt = pieces.select(*names, F.expr(f"{capacity} div length").alias("_k"), F.pmod(F.xxhash64("row", "start"), F.lit(buckets)).alias("_bucket"))
    group = Window.partitionBy("_k").orderBy("_bucket")
    counts = dealt.groupBy("_k", "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select("_k", "_bucket", (F.sum("_n").over(group) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_k")).alias("_all"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_k", "_bucket").orderBy("row", "start")) - 1)
    # at most 2 * sqrt(capacity) * buckets rows
    ranked = ranked.join(F.broadcast(counts), ["_k", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    full = F.expr("_rank < _k * (_all div _k)")
    binned = ranked.where(full).withColumn("_bin", F.expr("_rank div _k"))
    before = Window.partitionBy("_k", "_bin").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    packed = binned.select(*names, (F.shiftleft(F.col("_k"), 40) + F.col("_bin")).alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    rest = ranked.where(~full).select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", bin long, offset long"
    # fewer than k pieces a class: bounded by the capacity, not by the corpus
    rest = rest.groupBy(F.lit(1).alias("_one")).applyInArrow(_fill(capacity), schema)
    return packed.unionByName(rest.select(*names, F.col("bin").alias("sequence_id"), "offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack: id, start, length, doc_tokens, ids_crc32, sequence_id, offset, and ids if ``keep_ids``.

    Every id of every document lies in exactly one piece; a sequence holds at most ``capacity`` ids
    without gaps. Pieces are written once to the shared folder, since the packing reads them again.
    """
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, keep_ids)
    packed = harmonic_pack(written(pieces, "pieces"), capacity)
    return packed.drop("row")
