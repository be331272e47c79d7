"""Language identification, word first with backoff to character n-grams.

A word that the model knows scores by its log frequency in each language. A word that it has never
seen falls back: at each position the longest character n-gram that the model knows, from
``max_gram`` down to one character, gives the score. The model holds at most ``words`` words and
``grams`` n-grams per language, so its size is bounded by those parameters, and is learned from a
bounded sample of labelled rows (``sample_rows``).
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .folds import bounded_sample, clear_name

_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = 50_000, words: int = 20_000, grams: int = 20_000, max_gram: int = 4, least_count: int = 2) -> dict:
    """The model: languages, word table and n-gram table of log frequencies, of bounded size.

    Words seen fewer than ``least_count`` times are not in the word table; their n-grams count, as do
    those of every word over its whole length. Rows without a text or language are left out; repeated
    rows and ids count each; equally frequent words and n-grams are taken in their order; without rows
    the model knows no language.
    """
    rows = bounded_sample(labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")), "id", sample_rows)

    def count(batches):
        n = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n.update((lang, w) for w in _words(text))
            if len(n) > 200_000:
                yield out(n)
                n = Counter()
        yield out(n)

    def out(n):
        keys = list(n)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())], names=["lang", "w", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    counted = written(counted, "words")

    def ngrams(batches):
        n = Counter()
        for batch in batches:
            for lang, w, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                w = f"^{w}$"
                for size in range(1, max_gram + 1):
                    for i in range(len(w) - size + 1):
                        n[lang, w[i : i + size]] += k
                if len(n) > 200_000:
                    yield out(n)
                    n = Counter()
        yield out(n)

    gram_counts = written(counted.mapInArrow(ngrams, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")), "grams")

    totals = {r["lang"]: r["all"] for r in counted.groupBy("lang").agg(F.sum("n").alias("all")).collect()}
    langs = sorted(totals)
    ranked = counted.where(F.col("n") >= least_count).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w")))
    model: dict = {"langs": langs, "max_gram": max_gram}
    at = {k: i for i, k in enumerate(langs)}
    floor = [np.log(0.5 / (totals[k] + 1)) for k in langs]
    model["words"] = {}
    for r in ranked.where(F.col("r") <= words).select("lang", "w", "n").collect():
        model["words"].setdefault(r.w, np.array(floor, np.float32))[at[r.lang]] = np.log(r.n / (totals[r.lang] + 1))
    sized = gram_counts.withColumn("size", F.length("w"))
    size_totals: dict = {}
    for r in sized.groupBy("lang", "size").agg(F.sum("n").alias("all")).collect():
        size_totals[r.lang, r["size"]] = r["all"]
    model["grams"] = {}
    for r in sized.withColumn("r", F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "w"))).where(F.col("r") <= grams // max_gram).select("lang", "w", "n").collect():
        size = len(r.w)
        model["grams"].setdefault(r.w, np.array([np.log(0.5 / (size_totals.get((k, size), 0) + 1)) for k in langs], np.float32))[at[r.lang]] = np.log(r.n / (size_totals[r.lang, size] + 1))
    return model


#: Tokens of chunks joined by line ends: words, and the line ends.
_PARTS = re.compile(r"[^\W\d_]+|\n")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def packed(model: dict) -> dict:
    """A model as it travels: its words and n-grams as lists, their log frequencies as matrices."""
    rows = lambda table: np.array(list(table.values()), np.float32).reshape(len(table), len(model["langs"]))
    return model | {"words": list(model["words"]), "word_rows": rows(model["words"]), "grams": list(model["grams"]), "gram_rows": rows(model["grams"])}


def _signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Scorer:
    """Scores texts a batch at a time; the scores of up to ``most`` chunks without white space are kept per worker."""

    def __init__(self, model: dict, most: int = 200_000):
        model = model if "word_rows" in model else packed(model)
        self.langs, self.max_gram, self.most = model["langs"], model["max_gram"], most
        self.known = {w: i for i, w in enumerate(model["words"])}
        self.word_rows = model["word_rows"]
        # of each size the n-grams' hashes in order, and where their rows are; a row of zeros for no n-gram comes last
        self.gram_rows = np.concatenate([model["gram_rows"], np.zeros((1, len(self.langs)), np.float32)])
        self.sizes = {}
        for size in range(1, self.max_gram + 1):
            at = np.array([i for i, g in enumerate(model["grams"]) if len(g) == size], np.int64)
            held = self.hashed(_signs("".join(model["grams"][i] for i in at)), size)[::size]
            order = np.argsort(held)
            self.sizes[size] = held[order], at[order]
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs) + 1))  # the scores, and the number of words

    @staticmethod
    def hashed(signs: np.ndarray, size: int) -> np.ndarray:
        """A hash of the ``size`` signs from each on."""
        n = max(len(signs) - size + 1, 0)
        h = signs[:n].copy()
        for i in range(1, size):
            h = (h ^ (h >> np.uint64(29))) * _FACTOR + signs[i : i + n]
        return h

    def unseen(self, words: list[str]) -> np.ndarray:
        """The score of each word that the model does not know: the mean of the longest known n-grams at its positions; 0 for none."""
        marked = [f"^{w}$" for w in words]
        signs, lengths = _signs("".join(marked)), np.fromiter(map(len, marked), np.int64, len(marked))
        starts, left = np.cumsum(lengths) - lengths, np.repeat(np.cumsum(lengths), lengths) - np.arange(len(signs))
        found = np.full(len(signs), -1, np.int64)
        for size in range(self.max_gram, 0, -1):
            held, at = self.sizes[size]
            open_ = np.flatnonzero((found < 0) & (left >= size))
            if len(held) and len(open_):
                h = self.hashed(signs, size)[open_]
                place = np.minimum(np.searchsorted(held, h), len(held) - 1)
                hit = held[place] == h
                found[open_[hit]] = at[place[hit]]
        total = np.add.reduceat(self.gram_rows[found].astype(np.float64), starts)  # -1 is the row of zeros
        return total / np.maximum(np.add.reduceat(found >= 0, starts), 1)[:, None]

    def learn(self, chunks: list[str]) -> None:
        """Adds the scores of chunks that the worker has not met."""
        of, known, at_known, new, at_new, n = [], [], [], [], [], 0
        for part in _PARTS.findall("\n".join(chunks).lower()):
            if part == "\n":
                n += 1
            elif (i := self.known.get(part)) is not None:
                known.append(i)
                at_known.append(n)
            else:
                new.append(part)
                at_new.append(n)
        add = np.zeros((len(chunks), len(self.langs) + 1))
        for rows, at in ((self.word_rows[np.array(known, np.int64)], at_known), (self.unseen(new) if new else None, at_new)):
            if at:
                for j in range(len(self.langs)):
                    add[:, j] += np.bincount(at, rows[:, j], len(chunks))
                add[:, -1] += np.bincount(at, minlength=len(chunks))
        self.rows.update(zip(chunks, range(len(self.table), len(self.table) + len(chunks)), strict=True))
        self.table = np.concatenate([self.table, add])

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if self.langs and t and any(map(str.isalpha, t))]
        if not asked:
            return out
        chunks = [texts[i].split() for i in asked]
        if len(self.rows) >= self.most:
            self.rows, self.table = {}, self.table[:0]
        self.learn(list(set().union(*chunks).difference(self.rows)))
        for i, own in zip(asked, chunks, strict=True):
            found = self.table[list(map(self.rows.__getitem__, own))].sum(0)
            n = max(found[-1], 1)
            mean = found[:-1] / n
            odds = np.exp((mean - mean.max()) * min(n, 10.0))
            best = int(np.argmax(odds))
            out[i] = self.langs[best], float(odds[best] / odds.sum())
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


_SCORERS: dict = {}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, lang_pred, score of every whole text; with ``keep``, those columns of ``docs``, _lang_pred and _score.

    The two added columns come last; where ``docs`` has their names, theirs end in further underscores.
    Null texts and texts without a letter are ``und`` with score 0, as is everything if the model has
    no language; equal scores go to the first language by name; repeated rows and null ids stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))  # bounded by the model's parameters
    key = uuid.uuid4().hex  # a worker lives on between models
    names = keep or [id_col]
    lang, score = (clear_name(c, names) for c in (("_lang_pred", "_score") if keep else ("lang_pred", "score")))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(text_col).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def each(batches):
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        scorer = _SCORERS[key]
        for batch in (part for whole in batches for part in pa.Table.from_batches([whole]).to_batches(max_chunksize=200)):
            found = scorer.predict_all(batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    found = rows.mapInArrow(each, f"{kinds}, lang_pred string, score double")
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("lang_pred").alias(lang), F.col("score").alias(score))
