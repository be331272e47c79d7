"""Quality rules: a log-likelihood ratio between trusted text and the raw corpus over hashed n-grams.

Two multinomials over ``2 ** bits`` hash buckets of word unigrams and bigrams are counted: one over
all documents, one over the trusted ones. A document's score is the mean, over its n-grams, of
log(trusted) - log(raw); it is kept if the score is at least ``threshold``, the same for every
document and run. Counts are summed map-side, so a task sends a row per bucket at most; the model
that each task gets is one row of 2 ** bits numbers. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import clear_name

#: White space of the base rules; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def token_hashes(text: Column) -> Column:
    """64-bit hashes of a text's runs of letters or digits and runs of other signs, in order."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"), F.lit(0))
    return F.transform(parts, lambda w: F.xxhash64(w))


def buckets_of(text: Column, bits: int) -> Column:
    """Hash buckets of a text's tokens and of its pairs of neighbours; the last token's pair is with the end of the text."""
    mask = F.lit((1 << bits) - 1)
    pair = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)).bitwiseAND(mask))
    return let(token_hashes(text), lambda h: F.concat(F.transform(h, lambda x: x.bitwiseAND(mask)), pair(h)))


def llr_model(docs: DataFrame, trusted: DataFrame, text_col: str = "text", bits: int = 16) -> DataFrame:
    """One row: ratios, an array of 2 ** bits log ratios with add-one smoothing, of the texts of ``trusted`` to those of ``docs``.

    Without trusted text all ratios are 0. From the sums on, no table has more than 2 ** bits rows.
    """
    size = 1 << bits
    counts = lambda rows, n: rows.select(F.explode(buckets_of(F.col(text_col), bits)).alias("id")).groupBy("id").agg(F.count("*").alias(n))
    every = docs.sparkSession.range(size).join(counts(docs, "r"), "id", "left").join(counts(trusted, "t"), "id", "left").select("id", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    one = every.agg(F.sort_array(F.collect_list(F.struct("id", "t", "r"))).alias("all"), F.sum("t").alias("nt"), F.sum("r").alias("nr"))
    ratio = lambda x: F.log((x["t"] + 1.0) / (F.col("nt") + size)) - F.log((x["r"] + 1.0) / (F.col("nr") + size))
    return one.select(F.transform("all", lambda x: F.when(F.col("nt") > 0, ratio(x)).otherwise(F.lit(0.0))).alias("ratios"))


def llr_score(text: Column, ratios: Column, bits: int = 16) -> Column:
    """Mean log ratio over the n-grams of a text; 0 for a text without any."""
    at = lambda h: F.get(ratios, h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
    both = lambda h: F.transform(h, lambda x, i: at(x) + at(F.xxhash64(x, F.get(h, i + 1))))
    total = lambda h: F.aggregate(both(h), F.lit(0.0), lambda t, x: t + x)
    return let(token_hashes(text), lambda h: total(h) / F.greatest(2 * F.size(h), F.lit(1)))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, the first included."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)))
        repeated = F.transform(let(placed, again), lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(repeated))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    return let(let(hashes, windows), covered)


def base_rules(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; a null text counts as empty.

    Columns of these names that ``docs`` has are replaced: ``prefix`` keeps the added ones apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = lambda c: F.translate(c, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda line: bare(line) != "")
    counts = let(
        words_of(F.col(text_col)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    both = clear_name("_counts", docs.columns)
    out = docs.withColumn(both, counts).withColumns(
        {
            f"{prefix}n_words": F.col(f"{both}.n_words"),
            f"{prefix}word_chars": F.length(bare(text)).cast("long"),
            f"{prefix}n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            f"{prefix}n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            f"{prefix}n_repeat_words": F.col(f"{both}.n_repeat_words"),
        }
    )
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return out.drop(both).withColumn(f"{prefix}base_failed", (n < 50) | (100 * repeated > 50 * n))


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 16, threshold: float = -0.4, prefix: str = "") -> DataFrame:
    """Keeps all rows and columns of ``docs`` and adds the base counts, llr and kept.

    ``trusted_ids``: one column ``trusted_id``, the ids of trusted documents, as many as there are; nulls
    and repeats in it do no harm. A document that fails the base rules is not kept and has no llr (null).
    A null, empty or blank text has counts of 0 and fails the base rules; repeated rows count each;
    without trusted rows every llr is 0; an empty table gives an empty result. ``prefix`` keeps the added
    columns apart from those that ``docs`` has, which they otherwise replace.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # the same plan at every size: how many ids are trusted grows with the corpus
    trusted = named.join(trusted_ids.select(F.col("trusted_id").alias("_id")).hint("merge"), "_id", "left_semi")
    model = llr_model(named, trusted, "_text", bits).first()["ratios"]  # 2 ** bits numbers
    ratios = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # folded to a constant
    out = base_rules(docs, text_col, prefix)
    out = out.withColumn(f"{prefix}llr", F.when(~F.col(f"{prefix}base_failed"), llr_score(F.col(text_col), ratios, bits)))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}llr") >= threshold))
