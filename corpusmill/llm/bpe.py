"""BPE encoding and decoding through a distinct-word table.

A word is a run without ASCII white space. The tokenizer drops white space and never merges across
it, so a text's ids are its words' ids in order, and the library encodes a word alone as it does in
its text, added tokens inside it included.

1. Split: the distinct words of a partition (a block) are numbered; each document becomes the
   numbers of its words.
2. Distinct-word table: the words of all blocks are dealt to buckets by a hash, so all uses of a
   word meet in one task, which encodes it once. The words of a block travel as one sorted row for
   each bucket.
3. Join by position: the ids go back to their blocks, where they stand at the words' numbers and
   replace them in each document.
4. Decode: ids joined to the id-to-piece table, whose size is the vocabulary's.
"""

from __future__ import annotations

import os
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..scratch import bounded_batches, written

#: Rows that a Python worker sends at a time, so that no batch grows with the number of documents.
ROWS = 512


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _small(data: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data if isinstance(data, bytes) else data.tobytes())


def _large(data: bytes, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 32), kind)


def _blocks(batches, buckets: int, block_bytes: int):
    """Blocks of a partition: (block, ids, word numbers of each row, words by bucket). Words are numbered by bucket, then in order."""
    part, k = TaskContext.get().partitionId(), 0
    found, ids, rows, size = _Numbers(), [], [], 0

    def block():
        dealt: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in found:
            dealt[crc32(w) % buckets].append(w)
        number, at = np.zeros(len(found), np.uint32), 0
        for own in dealt:
            own.sort()
            number[np.fromiter(map(found.__getitem__, own), np.int64, len(own))] = np.arange(at, at + len(own))
            at += len(own)
        return (part << 24) + k, ids, (number[np.frombuffer(r, np.uint32)] for r in rows), dealt

    for batch in batches:
        for i, text in enumerate(batch.column(1).to_pylist()):
            data = (text or "").encode()
            rows.append(array("I", map(found.__getitem__, data.split())))
            size += len(data)
            if size >= block_bytes:
                ids.append(batch.column(0).slice(0, i + 1) if len(rows) > i else batch.column(0).slice(i + 1 - len(rows), len(rows)))
                yield block()
                found, ids, rows, size, k = _Numbers(), [], [], 0, k + 1
        if rows:
            held = sum(map(len, ids))
            ids.append(batch.column(0).slice(len(batch) - (len(rows) - held)))
    if rows:
        yield block()


def word_rows(docs: DataFrame, buckets: int, block_bytes: int = 12 << 20) -> DataFrame:
    """The words of each block: bucket, block, words (sorted, joined by line ends and compressed)."""

    def words(batches):
        for block, _, _, dealt in _blocks(batches, buckets, block_bytes):
            full = [b for b, own in enumerate(dealt) if own]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), block)), pa.array([_small(b"\n".join(dealt[b])) for b in full], pa.binary())], names=["bucket", "block", "words"])

    return docs.mapInArrow(words, "bucket int, block long, words binary")


def numbered(docs: DataFrame, buckets: int, block_bytes: int = 12 << 20) -> DataFrame:
    """A row for each document: block, id, words (its word numbers, compressed)."""
    kind = docs.schema[0].dataType.simpleString()

    def rows(batches):
        for block, ids, numbers, _ in _blocks(batches, buckets, block_bytes):
            packed = pa.array(map(_small, numbers), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), block)), pa.concat_arrays(ids), packed], names=["block", "id", "words"])

    return docs.mapInArrow(rows, f"block long, id {kind}, words binary")


def encoded_words(words: DataFrame, tokenizer_path: str, buckets: int, most: int = 1_000_000) -> DataFrame:
    """The distinct-word table, by block: bucket, block, lengths and ids (compressed uint32).

    All rows of a bucket are in one task, which encodes each distinct word once (``most`` words are
    held; beyond that the table starts anew).
    """

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        table: dict[bytes, bytes] = {}
        for batch in batches:
            lengths, ids = [], []
            for packed in batch.column(2).to_pylist():
                own = _large(packed, np.uint8).tobytes().split(b"\n")
                new = [w for w in own if w not in table]
                if len(table) + len(new) > most:
                    table.clear()
                    new = own
                for w, e in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                    table[w] = np.array(e.ids, "<u4").tobytes()
                found = list(map(table.__getitem__, own))
                lengths.append(_small(np.fromiter(map(len, found), np.uint32, len(found)) // 4))
                ids.append(_small(b"".join(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())], names=["bucket", "block", "lengths", "ids"])

    return words.repartition(buckets, "bucket").mapInArrow(encode, "bucket int, block long, lengths binary, ids binary")


def _joined(docs: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of a block with their ids: each word number replaced by what the word table has there."""
    words = words.sort_by("bucket")
    none = [np.zeros(0, np.uint32)]
    lengths = np.concatenate(none + [_large(x) for x in words["lengths"].to_pylist()]).astype(np.int64)
    flat = np.concatenate(none + [_large(x) for x in words["ids"].to_pylist()])
    starts = np.cumsum(lengths) - lengths
    schema = pa.schema([docs.schema.field("id"), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    out = []
    for batch in docs.select(["id", "words"]).combine_chunks().to_batches(max_chunksize=ROWS):
        ids, counts = [], []
        for packed in batch.column(1).to_pylist():
            seq = _large(packed)
            n = lengths[seq]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids.append(flat[np.repeat(starts[seq] - (ends - n), n) + np.arange(total)].tobytes())
            counts.append(total)
        out.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=schema))
    return pa.Table.from_batches(out, schema)


def encode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", stable: bool = False, block_bytes: int = 12 << 20, bucket_bytes: int = 4 << 30, most_buckets: int = 4096, task_bytes: int = 64 << 20
) -> DataFrame:
    """Ids of every whole text: id, n_tokens, ids (little-endian uint32).

    Null, empty and blank texts have no ids; repeated rows and null ids stay; an empty table gives an
    empty result; other columns are not read. The words are numbered twice, so each partition must
    hold the same rows in the same order both times: true of a scan of files (``stable``); any other
    input is first written to the shared folder. Buckets and tasks follow from the bytes of the texts,
    so no task grows with the corpus: a bucket has the words of ``bucket_bytes`` of text (of more where
    there would be over ``most_buckets``; its words pass through as a stream), and a task that joins the
    ids back has ``task_bytes`` of text, a block at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col), F.col(text_col))
    docs = docs if stable else written(docs, "texts")
    total, least = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0], int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, tasks = max(least, min(most_buckets, -(-total // bucket_bytes))), max(least, -(-total // task_bytes))
    back = encoded_words(word_rows(docs, buckets, block_bytes), tokenizer_path, buckets).repartition(tasks, "block")
    kind = docs.schema[0].dataType.simpleString()
    own = numbered(docs, buckets, block_bytes).repartition(tasks, "block")
    out = own.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_joined, f"id {kind}, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of the ids: each id joined to its piece in the id-to-piece table, special tokens kept.

    The pieces of a tokenizer without a decoder are joined by spaces, as the library does; ids that
    are not in the vocabulary give nothing; no ids (or null) give an empty text.
    """
    at = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{out_col}` string"

    def pieces(batches):
        tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        table = np.full(max(vocabulary.values()) + 1, None, object)
        for piece, i in vocabulary.items():
            table[i] = piece
        known, table = np.array([x is not None for x in table]), pa.array(table, pa.string())
        for batch in (part for whole in batches for part in pa.Table.from_batches([whole]).to_batches(max_chunksize=ROWS)):
            each = [np.frombuffer(x or b"", "<u4") for x in batch.column(at).to_pylist()]
            each = [x[known[np.minimum(x, len(known) - 1)] & (x < len(known))] for x in each]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), table.take(pa.array(np.concatenate(each) if each else np.zeros(0, np.uint32)))), " ")
            yield pa.RecordBatch.from_arrays([*batch.columns, joined.cast(pa.string())], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(pieces, schema)
