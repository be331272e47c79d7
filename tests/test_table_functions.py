"""Chunks from SQL equal those of the operator."""

from corpusmill.functions import tables
from corpusmill.operators import chunking as C
from corpusmill.sources.tables import table


def test_chunks_in_sql(spark, sf_dir):
    tables.register(spark)
    docs = table(spark, sf_dir, "documents").where("doc_id < 40").union(spark.createDataFrame([(-1, None, "x", "y", 0), (-2, "", "x", "y", 0)], table(spark, sf_dir, "documents").schema))
    docs.createOrReplaceTempView("some_documents")
    for name, spans in (("text_chunks", C.recursive_spans), ("sentence_chunks", C.sentence_spans)):
        got = spark.sql(f"SELECT d.doc_id, c.* FROM some_documents d, LATERAL {name}(d.text, 300, 30) c")
        want = C.chunked(docs, "doc_id", "text", lambda t: spans(t, 300, 30))  # noqa: B023
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 40
