"""One query for each operator, over its whole table, and SQL where it can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh_path, written
from ..sources.tables import table
from . import bpe, filter_audit, folds, hard_negatives, language_id, mtree, packing, quality_classifier, quality_rules, sharding, simhash, token_counts, warc, winnowing

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, stable=True), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=1, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = winnowing.edited_by_next(table(spark, sf_dir, "documents"))
    return prints.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        winnowing.as_text(F.col("fingerprint")).alias("fingerprint"),
        winnowing.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    warc.write_arc(table(spark, sf_dir, "pages"), arcs, id_col="page_id", url_col="url", body_col="html")
    warc.convert(spark, arcs, warcs)
    read = warc.read_warc(spark, warcs).where("record_type in ('response', 'revisit')")
    own = spark.read.parquet(f"{sf_dir}/pages.parquet").schema["page_id"].dataType
    return read.select(F.col("source_id").cast(own).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_id").cast(own).alias("refers_to"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents that ``labels`` marks as good."""
    return table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ruled = quality_rules.quality_rules(docs, trusted_ids(spark, sf_dir))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~folds.held_out("doc_id")), "doc_id", "text", "lang")
    return language_id.predict(docs, model).select("doc_id", folds.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    # the row's number in its file is the same on every cluster
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", size.alias("size"), F.xxhash64(place).alias("place"))
    shards = sharding.external_shuffle(docs, ["doc_id", "text", "place"], "size", fresh_path(spark, "shards"), place=F.lit(0))
    return shards.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~folds.held_out("doc_id")).select("doc_id", "quality")
    weights = quality_classifier.train(docs, labels, "doc_id", "text", "quality")
    scored = quality_classifier.score(docs, weights)
    return scored.select("doc_id", folds.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    rows = filter_audit.with_repeated(written(filter_audit.measures(table(spark, sf_dir, "documents")), "measures"))
    rows = filter_audit.with_marks(rows, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    filters = {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        "C": 100 * F.col("n_upper") > 10 * F.col("n_chars"),
        "D": F.col("symbol"),
        "E": F.col("repeated"),
    }
    return filter_audit.audit(rows, filters, "part", {"good": F.col("good"), "toxic": F.col("toxic")})


def op13_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score")


QUERIES = {q.__name__: q for q in (op1_bpe_round_trip, op2_harmonic_packing, op3_token_counts, op4_winnowing, op5_arc_to_warc, op6_quality_rules, op7_language_id, op8_external_shuffle, op9_quality_classifier, op10_simhash_near_dedup, op11_hard_negatives, op12_filter_audit, op13_mtree_top_k)}

#: All orders of five filters, and each step of one.
_AUDIT = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
m AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first_id, false)} AS fails
  FROM w LEFT JOIN m USING (doc_id)),
s AS (SELECT part, good, toxic, concat(CASE WHEN fails.A THEN 'A' ELSE '' END, CASE WHEN fails.B THEN 'B' ELSE '' END, CASE WHEN fails.C THEN 'C' ELSE '' END,
  CASE WHEN fails.D THEN 'D' ELSE '' END, CASE WHEN fails.E THEN 'E' ELSE '' END) AS failed FROM f),
n AS (SELECT part, failed, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM s GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT contains(failed, own) AND translate(failed, before, '') = failed THEN docs ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') = failed THEN docs ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') <> failed THEN docs ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = own THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') = failed THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM n, p GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

#: Vectors as whole numbers; a row's number tells rows apart.
_POINTS = """
v AS (SELECT row_number() OVER () AS pos, vec_id, label, [CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""
_TOP_K = f"""
WITH {_POINTS.format(factor=1024)},
q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.pos, q.vec_id AS query_id, v.vec_id, v.pos AS other, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.x, v.x)]) AS BIGINT) AS score FROM q JOIN v ON q.pos <> v.pos)
SELECT query_id, CAST(row_number() OVER (PARTITION BY pos ORDER BY score DESC, vec_id NULLS LAST, other) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
_HARD_NEGATIVES = f"""
WITH {_POINTS.format(factor=256)},
l AS (SELECT pos, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM v WHERE label IS NOT NULL),
s AS (SELECT a.pos, a.vec_id AS anchor_id, c.pos AS other, c.vec_id, a.label = c.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.x, c.x)]) AS BIGINT) AS score
  FROM l a JOIN l c ON a.vec_id % 50 = 0 AND a.pos <> c.pos),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY pos ORDER BY score DESC, vec_id NULLS LAST, other) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.pos, p.other ORDER BY n.score DESC, n.vec_id NULLS LAST, n.other) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.pos = n.pos AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": _HARD_NEGATIVES, "op12_filter_audit": _AUDIT, "op13_mtree_top_k": _TOP_K}
