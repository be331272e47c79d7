"""Rows that repeat in id and text scatter over the buckets of the external shuffle."""

from pyspark.sql import functions as F

from corpusmill.llm import sharding
from corpusmill.scratch import fresh_path


def test_repeated_rows_scatter(spark):
    n = F.col("id")
    rows = spark.range(3000).select(F.when(n % 3 != 0, n).alias("doc_id"), F.when(n % 3 != 0, F.concat(F.lit("text "), n.cast("string"))).alias("text"), F.lit(10).cast("long").alias("size"))
    got = sharding.external_shuffle(rows, ["doc_id", "text"], "size", fresh_path(spark, "shards"), bucket_bytes=1_000).collect()
    assert sorted(r.slot * 8 + r.shard for r in got) == list(range(3000))
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [i for i in range(3000) if i % 3]
    repeats = [r.slot * 8 + r.shard for r in got if r.text is None]
    assert len(repeats) == 1000 and max(repeats) - min(repeats) > 2000
