"""Table functions for SQL: ``SELECT d.doc_id, c.* FROM documents d, LATERAL text_chunks(d.text, 500, 50) c``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunking import recursive_spans, sentence_spans

CHUNK = "chunk_index int, text string, char_start int, char_end int"


@udtf(returnType=CHUNK)
class TextChunks:
    """The chunks of a text, cut at separators; null and empty texts have none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int, int]]:
        for n, (a, b) in enumerate(recursive_spans(text, size, overlap) if text else []):
            yield n, text[a:b], a, b


@udtf(returnType=CHUNK)
class SentenceChunks:
    """The chunks of a text, made of whole sentences; null and empty texts have none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int, int]]:
        for n, (a, b) in enumerate(sentence_spans(text, size, overlap) if text else []):
            yield n, text[a:b], a, b


def register(spark: SparkSession) -> None:
    """Makes ``text_chunks`` and ``sentence_chunks`` (text, size, overlap) known to the session's SQL."""
    spark.udtf.register("text_chunks", TextChunks)
    spark.udtf.register("sentence_chunks", SentenceChunks)
