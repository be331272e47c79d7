"""Two-pass external shuffle into shards of equal row counts.

First pass: a seeded hash of each record and its place scatters the records uniformly over buckets, as many as
keep a bucket within ``bucket_bytes``, so each fits into a worker's memory whatever the corpus.
Second pass: each bucket is put into a fixed order and then shuffled as Spark's seeded ``shuffle``
does it, a Fisher-Yates walk, and its records are written in that order. The buckets one after the
other are a uniform permutation of the corpus; its row r goes to shard ``r % shards``, slot
``r // shards``, so the shards' counts differ by one at most. Everything is DataFrame functions.

``shuffle`` mixes the number of its partition into the seed, so the buckets are dealt to partitions by
their own numbers, in partitions as many as the buckets ask for: the walk depends on the seed, the data
and the parameters alone, not on the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import clear_name


def external_shuffle(
    rows: DataFrame, key_cols: list[str], size_col: str, path: str, shards: int = 8, seed: int = 20_240_601, bucket_bytes: int = 16 << 20, most_buckets: int = 1 << 20, most_tasks: int = 100_000, place: Column | None = None
) -> DataFrame:
    """Writes the shards to ``path`` (Parquet folders ``shard=0`` and so on) and returns them as read back.

    All columns of ``rows``, then slot (long, gapless from 0 in each shard) and shard (int); where ``rows``
    has these names, the added ones end in underscores. ``key_cols`` are hashed together with the row's
    place in ``rows``, so rows that repeat in all key columns scatter as well: ``place`` if given (such as
    the row's number in its file, which no cluster changes), else its number in this session's partitions.
    ``rows`` is read again for the counts and must give the same rows in the same order: a scan of files.
    Buckets grow beyond ``bucket_bytes`` where there would be more than ``most_buckets``, which bounds the
    broadcast table of their starts. Any two rows may be equal, and nulls are ordinary values; an empty
    table gives an empty result. Columns that Spark cannot sort (maps) are not supported.
    """
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum(F.col(f"`{size_col}`")), F.lit(0)).cast("long")).first()[0]
    buckets = max(1, min(most_buckets, -(-int(total) // bucket_bytes)))
    tasks = min(buckets, most_tasks)
    shard, slot = clear_name("shard", rows.columns), clear_name("slot", rows.columns)
    record = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)))
    # a hash of a hash: the bits that pick the bucket are not those that partition the exchange
    own = F.monotonically_increasing_id() if place is None else place
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.xxhash64(*(F.col(f"`{c}`") for c in key_cols), own)), F.lit(buckets))
    scattered = rows.select(record.alias("_r"), bucket.alias("_b"))
    # a row per bucket, most_buckets at most
    counts = scattered.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_start"))
    dealt = scattered.withColumn("_task", F.pmod("_b", F.lit(tasks)).cast("int")).repartitionById(tasks, "_task")
    # a fixed order of records and of buckets, so that a task that runs again shuffles alike
    ordered = dealt.groupBy("_task", "_b").agg(F.sort_array(F.collect_list("_r")).alias("_all")).join(F.broadcast(starts), "_b").sortWithinPartitions("_b")
    walked = ordered.select("_start", F.posexplode(F.expr(f"shuffle(_all, {int(seed)})")).alias("_p", "_r"))
    at = F.col("_start") + F.col("_p")
    kept = [F.col(f"_r.c{i}").alias(c) for i, c in enumerate(rows.columns)]
    placed = walked.select(*kept, F.expr(f"(_start + _p) div {int(shards)}").alias(slot), (at % shards).cast("int").alias(shard))
    placed.write.option("compression", "zstd").partitionBy(shard).parquet(path)
    return spark.read.schema(placed.schema).parquet(path)
