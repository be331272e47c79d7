"""Model output and answers put back to their source: where pieces stand, what headings they lost, what an answer shares."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_object, strip
from .chunking import chunked
from .structure import headings

# How much of a piece must be found, how many heading lines go before a piece; the labels of pieces, and the one for all others.
LEAST_SHARE = 0.5
HEADING_LINES = 3
LABELS = ["论述类", "事实类", "操作类", "数据类"]
OTHER_LABEL = "其他"
#: Signs of a gram by which pieces are found, and in how many places of a text one may stand to tell something.
GRAM, RARE = 8, 16
#: White space of Unicode, that which a string's ``isspace`` has (some more), a factor of hashes, images in Markdown.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACES = np.array([chr(i).isspace() for i in range(0x3001)])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")


def label(c: Column) -> Column:
    """A known label as it is, any other as the label for all others."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    return F.when(bare.isin(LABELS), bare).otherwise(OTHER_LABEL)


def model_chunks(answers: DataFrame, id_col: str, answer_col: str) -> DataFrame:
    """id, n, text, label of the chunks in a model's answers: a JSON object with chunks, fenced, bare or among other text.

    Chunks without text are left out, n counts those that stay from 0; unknown labels become that for all others.
    An answer without such an object gives no rows.
    """
    read = answers.select(F.col(id_col), json_object(F.col(answer_col), "chunks array<struct<text: string, label: string>>").alias("o"))
    kept = F.filter("o.chunks", lambda c: F.coalesce(strip(c["text"]), F.lit("")) != "")
    return read.select(id_col, F.posexplode(kept).alias("n", "c")).select(id_col, "n", strip(F.col("c.text")).alias("text"), label(F.col("c.label")).alias("label"))


def image_urls(c: Column) -> Column:
    """Distinct addresses of stored images in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"/api/files/images/[^\s)\"'<>\]]+"), F.lit(0)))


def _chain(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of ``points`` (x, y) in which both rise. Points are in order of x, of equal x the higher y first."""
    tails: list[int] = []  # the least y in which a chain of each length ends
    ends: list[int] = []  # and the point there
    before: list[int] = []
    for n, (_, y) in enumerate(points):
        k = bisect_left(tails, y) if tails and y <= tails[-1] else len(tails)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(y)
            ends.append(n)
        else:
            tails[k], ends[k] = y, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(points[n])
        n = before[n]
    return out[::-1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the GRAM signs from each place on."""
    h, width = codes.astype(np.uint64), 1
    while width < GRAM:
        h = (h[:-width] * _FACTOR) ^ (h[width:] + (h[width:] >> np.uint64(29))) if len(h) > width else h[:0]
        width *= 2
    return h


def _anchored(text: str, pieces: list[str]) -> list[set[int]]:
    """For each piece, how far grams that it shares with the text stand from their places in it, such that all pieces together go one way."""
    own, given = _codes(text), _codes("".join(pieces))
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes) - sizes
    held, asked = _grams(own), _grams(given)
    of = np.repeat(np.arange(len(pieces)), sizes)
    xs = np.flatnonzero((of[: len(asked)] == of[GRAM - 1 :]) if len(asked) else of[:0])
    order = np.argsort(held, kind="stable")
    low, high = (np.searchsorted(held[order], asked[xs], side) for side in ("left", "right"))
    few = (high > low) & (high - low <= RARE)
    xs, high, many = xs[few], high[few], (high - low)[few]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    x, y = np.repeat(xs, many), order[np.repeat(high, many) - 1 - nth]  # of one place in a piece the last in the text first
    for i in range(GRAM):  # equal hashes may be of different grams
        same = given[x + i] == own[y + i]
        x, y = x[same], y[same]
    out: list[set[int]] = [set() for _ in pieces]
    if (np.diff(x) <= 0).any() or (np.diff(y) <= 0).any():
        chain = np.array(_chain(list(zip(x.tolist(), y.tolist(), strict=True))), np.int64).reshape(-1, 2)
        x, y = chain[:, 0], chain[:, 1]
    n = of[x]
    shifts = y - (x - starts[n])
    fresh = np.r_[True, (np.diff(n) != 0) | (np.diff(shifts) != 0)][: len(n)]
    for i, shift in zip(n[fresh].tolist(), shifts[fresh].tolist(), strict=True):
        out[i].add(shift)
    return out


def _run(text: str, piece: str, shifts: set[int], low: int) -> tuple[int, int]:
    """The longest stretch that the piece and the text share at one of the shifts, not before ``low``."""
    best = (0, 0)
    for shift in shifts:
        lo, hi = max(0, low - shift, -shift), min(len(piece), len(text) - shift)
        if hi - lo < best[1] - best[0]:
            continue
        ours, theirs = piece[lo:hi], text[lo + shift : hi + shift]
        ends = [] if ours == theirs else [i for i, (a, b) in enumerate(zip(ours, theirs, strict=True), lo) if a != b]
        starts = [lo, *(i + 1 for i in ends)]
        for a, b in zip(starts, [*ends, hi], strict=True):
            best = max(best, (a + shift, b + shift), key=lambda r: (r[1] - r[0], -r[0]))
    return best


def aligned_spans(text: str, pieces: list[str]) -> list[tuple[int, int] | None]:
    """Where each piece of a model's answer stands in the text, one after the other; None where it is not found.

    White space does not count. Rare grams that pieces and text share are points, and the longest chain of
    points in which both go forward says where the pieces stand, all of them at once. A piece's span is the
    longest stretch through its points that is shared sign by sign; half of the piece must be in it. A piece
    without points (short, or of common words) stands where all of it is found between its neighbours.
    """
    flat = "".join(str.split(text))
    codes = _codes(text)
    places = np.flatnonzero(~((codes < len(_SPACES)) & _SPACES[np.minimum(codes, len(_SPACES) - 1)]))
    bare = ["".join((p or "").split()) for p in pieces]
    shared = _anchored(flat, bare)
    runs: list[tuple[int, int] | None] = []
    low = 0
    for piece, points in zip(bare, shared, strict=True):
        run = _run(flat, piece, points, low) if points else (0, 0)
        runs.append(run if run[1] - run[0] >= max(1, LEAST_SHARE * len(piece)) else None)
        low = runs[-1][1] if runs[-1] else low
    ahead = [len(flat)] * (len(runs) + 1)
    for n in reversed(range(len(runs))):
        ahead[n] = runs[n][0] if runs[n] else ahead[n + 1]
    low = 0
    for n, piece in enumerate(bare):
        if not runs[n] and piece and (i := flat.find(piece, low, ahead[n])) >= 0:
            runs[n] = i, i + len(piece)
        low = runs[n][1] if runs[n] else low
    return [(int(places[r[0]]), int(places[r[1] - 1]) + 1) if r else None for r in runs]


def with_lost_headings(text: str, spans: list[tuple[int, int]], heads: list[int]) -> list[tuple[int, int]]:
    """Spans whose starts are moved to the headings over them (offsets in order) that neither they nor the span before have.

    Up to three heading lines with nothing but white space between.
    """
    lines = [text[h : e if (e := text.find("\n", h)) >= 0 else len(text)] for h in heads]
    stacked = [0] * len(heads)  # how many headings stand right above each
    for n in range(1, len(heads)):
        stacked[n] = 0 if text[heads[n - 1] + len(lines[n - 1]) : heads[n]].strip() else stacked[n - 1] + 1
    out, last = [], 0
    for a, b in spans:
        start, n = a, bisect_right(heads, a) - 1
        if n >= 0 and last <= heads[n] < a and "".join(lines[n].split()) not in "".join(text[a:b].split()):
            top = max(n - min(stacked[n], HEADING_LINES - 1), bisect_left(heads, last))
            start = heads[top]
        out.append((start, b))
        last = b
    return out


def aligned_chunks(docs: DataFrame, id_col: str, text_col: str, pieces_col: str) -> DataFrame:
    """A model's pieces of each text (array of strings) as chunks of the text itself, lost headings back: id, chunk_index, text, char_start, char_end.

    Pieces that are not found are left out; a text of which none is found has no chunks.
    """
    heads = headings(docs, id_col, text_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.col("start").cast("long"))).alias("_heads"))
    given = docs.select(id_col, text_col, F.coalesce(F.col(pieces_col), F.array().cast("array<string>")).alias("_pieces")).join(heads, id_col, "left")
    given = given.withColumn("_heads", F.coalesce("_heads", F.array().cast("array<bigint>")))

    def spans(text: str, pieces: list[str], found: list[int]) -> list[tuple[int, int]]:
        return with_lost_headings(text, [s for s in aligned_spans(text, pieces) if s], found)

    return chunked(given, id_col, text_col, spans, ["_pieces", "_heads"])


def shared_ranges(answer: str, source: str, width: int, gap: int) -> list[tuple[int, int]]:
    """Ranges of one source that its answer has too, as ``highlights`` has them."""
    answer = _WHITE.sub("", answer)
    grams = {answer[i : i + width] for i in range(len(answer) - width + 1)}
    images = [m.span() for m in _IMAGE.finditer(source)] if "![" in source else []
    out: list[tuple[int, int]] = []
    for a, b in zip([0, *(e for _, e in images)], [*(s for s, _ in images), len(source)], strict=True):
        part = source[a:b]
        bare = _WHITE.sub("", part)
        hits = [i for i in range(len(bare) - width + 1) if bare[i : i + width] in grams]
        if hits:
            at = range(a, b) if len(bare) == len(part) else [a + i for i, c in enumerate(part) if not _WHITE.match(c)]
            first = [n for n, i in enumerate(hits) if not n or i - (hits[n - 1] + width) > gap]
            out += [(at[hits[m]], at[hits[n - 1] + width - 1] + 1) for m, n in zip(first, [*first[1:], len(hits)], strict=True)]
    return out


def highlights(pairs: DataFrame, id_col: str, answer_col: str, source_col: str, width: int = 4, gap: int = 2) -> DataFrame:
    """Ranges of each source that its answer has too: id, start, end.

    White space apart, every ``width`` signs of the source that the answer has are part of a range, and
    ranges at most ``gap`` signs apart are one. Images in the source are never part of one. An id is one pair.
    """

    @F.pandas_udf("array<struct<start: bigint, end: bigint>>")
    def ranges(answers: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in shared_ranges(t or "", s or "", width, gap)] for t, s in zip(answers, sources, strict=True)], dtype=object)

    return pairs.select(F.col(id_col), F.explode(ranges(answer_col, source_col)).alias("r")).select(id_col, "r.start", "r.end")
