"""Token counts by a map-side two-tier lookup.

First tier: a broadcast table of the lengths of the most frequent pre-tokens (``table_rows`` at most,
so its size has a bound that does not grow with the corpus), as Arrow columns. Second tier: every
pre-token that is not in it is encoded by the tokenizer once per worker and kept in that worker's bounded
cache. Both tiers give what the library gives, so the table decides the speed and never a count. A
worker also remembers the sums of space-separated chunks, a few pre-tokens each. No pre-token of the
corpus is shuffled: the pass that finds the frequent ones exchanges ``task_rows`` summed rows per task
at most.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import chunk_ids

#: Chunks that a task counts at a time; the rarer half goes when there are more.
_COUNTED = 400_000


def frequent_pretokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", table_rows: int = 65_536, task_rows: int = 4_096) -> DataFrame:
    """The most frequent pre-tokens of all texts: columns pretoken, n. At most ``table_rows`` rows."""

    def summary(batches):
        ids, n = chunk_ids(tokenizer_path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and (chunks := ids.chunks(text)):
                    n.update(chunks[1:])
            if len(n) > _COUNTED:
                n = Counter(dict(n.most_common(_COUNTED // 2)))
        parts: Counter = Counter()
        for chunk, times in n.items():
            for part in ids.pretokens(" " + chunk):
                parts[part] += times
        top = parts.most_common(task_rows)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], names=["pretoken", "n"])

    return docs.select(F.col(text_col)).mapInArrow(summary, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(table_rows)


class Lengths(dict):
    """Chunk -> number of tokens of " " + chunk, for up to ``most`` chunks; pre-tokens come from the broadcast table or the tokenizer."""

    def __init__(self, path: str, table: bytes, most: int = 500_000):
        super().__init__()
        self.ids, self.most = chunk_ids(path), most
        rows = pa.ipc.open_stream(table).read_all()
        self.table: dict[str, int] = dict(zip(rows["pretoken"].to_pylist(), rows["length"].to_pylist(), strict=True))

    def part(self, pretoken: str) -> int:
        n = self.table.get(pretoken)
        return len(self.ids.part(pretoken)) // 4 if n is None else n

    def whole(self, text: str) -> int:
        return sum(map(self.part, self.ids.pretokens(text)))

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[chunk] = n = self.whole(" " + chunk)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        chunks = self.ids.chunks(text)
        if chunks is None:
            return len(self.ids.encoded(text)) // 4
        return self.whole(chunks[0]) + sum(map(self.__getitem__, chunks[1:]))


_TIERS: dict[str, Lengths] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", table_rows: int = 65_536) -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; null ids stay;
    an empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col), F.col(text_col))
    # bounded by table_rows short strings, whatever the corpus
    frequent = [r.pretoken for r in frequent_pretokens(docs, tokenizer_path, text_col, table_rows).select("pretoken").collect()]
    ids = chunk_ids(tokenizer_path)
    rows = pa.table({"pretoken": pa.array(frequent, pa.string()), "length": pa.array([len(ids.part(x)) // 4 for x in frequent], pa.uint32())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    key = uuid.uuid4().hex  # a worker lives on between tables
    kind = docs.schema[0].dataType.simpleString()

    def count(batches):
        if key not in _TIERS:
            _TIERS.clear()
            _TIERS[key] = Lengths(tokenizer_path, shared.value)
        lengths = _TIERS[key]
        for batch in batches:
            text = batch.column(1)
            n = pa.array(list(map(lengths.count, text.to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), n], names=["id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
