"""The pipeline's stages against brute force on the small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import minhash, packing, queries
from corpusmill.scratch import written


def similarity(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b)) if len(a) + len(b) else 1.0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    rules = {r.doc_id: r.kept for r in queries.op6_quality_rules(spark, sf_dir).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = kept, written(stage(spark, docs, sf_dir), "stage")
        kept = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(kept) <= set(before)
        if name == "quality rules":
            assert set(kept) == {d for d in before if rules[d]}
        elif name == "language id":
            assert set(kept) == set(before)  # nothing here is without a language
        else:
            # one document of each group of five-word shingle sets with a similarity of 0.8 or more, by brute force
            sets, root = {d: minhash.shingle_set(r.text, 5) for d, r in before.items()}, {d: d for d in before}
            for d in sorted(before):
                for e in sorted(before):
                    if e < d and similarity(sets[d], sets[e]) >= 0.8:
                        a, b = sorted((root[d], root[e]))
                        root = {k: a if v == b else v for k, v in root.items()}
            assert set(kept) == set(root.values()) and len(kept) < len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    totals = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert set(totals) == set(kept) and packed.agg({"length": "sum"}).first()[0] == sum(totals.values())
    assert packing.cuts(5000, 2048)[:2] == [2048, 2048]


def test_odd_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["_row", "_q_kept", "counts", "_counts", "_lang_pred", "_score", "shard", "slot", "id", "row", "text_", "`dotted.name`".strip("`")]
    clash = docs.select("*", *(F.lit(f"mine {n}").alias(n) for n in names))
    odd = clash.limit(20).withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string")}).unionByName(clash.limit(5).withColumn("text", F.lit(None).cast("string")))
    docs = written(clash.unionByName(clash.limit(30)).unionByName(odd), "odd")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
    first = docs.first()
    assert docs.count() and all(first[n] == f"mine {n}" for n in names)
    assert docs.where("text is null").count() == 0 and docs.groupBy("doc_id", "text").count().where("count > 1").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


@pytest.mark.parametrize("at", range(4))
def test_empty_table(spark, sf_dir, at):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[at][1](spark, docs, sf_dir).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
