"""Chunkers: one document becomes rows (chunk_index, text, char_start, char_end).

Offsets are code points of the full text, half open, and ``text`` is always the slice between them.
Splitting by a rule of lines or paragraphs is relational (explode, running sums); only the greedy
filling of a chunk, which depends on what went before, is a small function over one text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Separators of the recursive splitter, coarse to fine, and what ends a sentence.
SEPARATORS = ["\n\n", "\n", "。", "；", " "]
SENTENCE = r"[^。！？.!?]+[。！？.!?]?"
QUESTION = r"(?m)^\s*(?:问|Q|q)\s*[:：]"
HEADING = r"^(#{1,6})\s+\S"


def pieces_of(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """The parts of each text between matches of ``pattern``: id, n, piece, start, end; blank parts stay.

    A part's start is the length of all parts and separators before it, so the separators are found too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts, gaps = F.split(text, pattern), F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    rows = docs.select(F.col(id_col), F.posexplode(F.arrays_zip(parts.alias("piece"), gaps.alias("gap"))).alias("n", "p"))
    rows = rows.select(id_col, "n", "p.piece", F.length("p.gap").alias("gap")).where("piece is not null")
    order = Window.partitionBy(id_col).orderBy("n")
    end = F.sum(F.col("gap") + F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(id_col, "n", "piece", (end - F.length("piece")).alias("start"), end.alias("end"))


def grouped(pieces: DataFrame, id_col: str, begins: Column, source: DataFrame, source_id: str, text_col: str) -> DataFrame:
    """Runs of pieces, a new run at each piece where ``begins``: id, chunk_index, text, char_start, char_end."""
    order = Window.partitionBy(id_col).orderBy("n")
    numbered = pieces.withColumn("run", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(id_col, "run").agg(F.min("start").alias("char_start"), F.max("end").alias("char_end"))
    spans = spans.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(id_col).orderBy("run")) - 1).cast("int"))
    texts = source.select(F.col(source_id).alias(id_col), F.col(text_col).alias("_full"))
    cut = F.substring(F.col("_full"), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    return spans.join(texts, id_col).select(id_col, "chunk_index", cut.alias("text"), F.col("char_start").cast("int"), F.col("char_end").cast("int"))


def question_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Paragraphs up to the first question are one chunk; each paragraph with a question starts one with all up to the next."""
    paragraphs = pieces_of(docs, id_col, text_col, r"\n\s*\n").where(F.trim("piece") != "")
    return grouped(paragraphs, id_col, F.col("piece").rlike(QUESTION), docs, id_col, text_col)


def title_sections(docs: DataFrame, id_col: str, text_col: str, level: int = 2) -> DataFrame:
    """Sections that start at Markdown headings of ``level`` or above; what precedes the first is a section too."""
    lines = pieces_of(docs, id_col, text_col, r"\n")
    depth = F.length(F.regexp_extract("piece", HEADING, 1))
    return grouped(lines, id_col, (depth > 0) & (depth <= level), docs, id_col, text_col)


def heading_paths(docs: DataFrame, id_col: str, text_col: str, levels: int = 3) -> DataFrame:
    """The chain of headings over each line: id, n, path, an as-of join by the last heading of each level seen so far."""
    lines = pieces_of(docs, id_col, text_col, r"\n")
    depth = F.length(F.regexp_extract("piece", HEADING, 1))
    before = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({f"h{k}": F.when(depth == k, F.struct(F.col("n"), F.trim(F.regexp_replace("piece", r"^#+\s*", "")).alias("t"))) for k in range(1, levels + 1)})
    seen = marked.withColumns({f"h{k}": F.last(f"h{k}", ignorenulls=True).over(before) for k in range(1, levels + 1)})
    valid = [F.when(F.lit(True) if k == 1 else F.col(f"h{k}.n") > F.greatest(*(F.coalesce(F.col(f"h{j}.n"), F.lit(-1)) for j in range(1, k)), F.lit(-1)), F.col(f"h{k}.t")) for k in range(1, levels + 1)]
    return seen.select(id_col, "n", F.concat_ws(" > ", *valid).alias("path"))


def _recursive(text: str, at: int, size: int, separators: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of at most ``size``: cut at the first separator that occurs, neighbours joined while they fit."""
    if len(text) <= size:
        if text.strip():
            yield at, at + len(text)
        return
    rest = list(separators)
    while rest and rest[0] not in text.strip(rest[0]):
        rest.pop(0)
    if not rest:
        for i in range(0, len(text), size):
            yield at + i, at + min(i + size, len(text))
        return
    ends, i = [], 0
    while (i := text.find(rest[0], i)) >= 0:
        i += len(rest[0])
        ends.append(i)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    start = last = 0
    for end in ends:
        if end - start > size and last > start:
            yield from _recursive(text[start:last], at + start, size, rest[1:])
            start = last
        last = end
    if last > start:
        yield from _recursive(text[start:last], at + start, size, rest[1:])


def _apart(text: str, protected: Iterable[tuple[int, int]], at: int) -> Iterator[tuple[int, int, bool]]:
    """Spans of a text whose first sign stands at ``at``: what lies between protected ranges, and these, marked."""
    here = 0
    for a, b in protected:
        a, b = max(a - at, here), min(b - at, len(text))
        if a < b:
            yield here, a, False
            yield a, b, True
            here = b
    yield here, len(text), False


def _bare(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The span without white space at its ends; none for a blank one."""
    part = text[a:b]
    a += len(part) - len(part.lstrip())
    return [(a, a + len(part.strip()))] if part.strip() else []


def _delimited(delimiter: str | list[str] | None) -> list[str]:
    """The separators: one of your own comes before the usual ones, a list replaces them, an empty list does not."""
    if isinstance(delimiter, str) and delimiter:
        return [delimiter, *SEPARATORS]
    return [d for d in delimiter or [] if d] or SEPARATORS


def recursive_spans(text: str, size: int, overlap: int = 0, separators: list[str] = SEPARATORS, protected: Iterable[tuple[int, int]] = (), at: int = 0) -> list[tuple[int, int]]:
    """Spans in order; each but the first reaches back by ``overlap``, but never into a protected range.

    ``protected`` ranges, given by offsets of a text in which ours begins at ``at``, are chunks of their own whatever their size.
    """
    out: list[tuple[int, int]] = []
    for lo, hi, whole in _apart(text, protected, at):
        spans = _bare(text, lo, hi) if whole else list(_recursive(text[lo:hi], lo, size, separators))
        out += [(max(lo, a - overlap) if i and not whole else a, b) for i, (a, b) in enumerate(spans)]
    return out


def sentence_spans(text: str, size: int, overlap: int = 0, delimiter: str | list[str] | None = None, protected: Iterable[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Whole sentences filled into chunks of at most ``size``, paragraph by paragraph; longer sentences are cut recursively.

    A list of delimiters also cuts paragraphs, and stays out of the chunks; see ``_delimited``.
    """
    spans: list[tuple[int, int]] = []
    separators = _delimited(delimiter)
    borders = "|".join(["\n\n", *(re.escape(d) for d in separators if isinstance(delimiter, list) and delimiter)])
    for lo, hi, whole in _apart(text, protected, 0):
        if whole:
            spans += _bare(text, lo, hi)
            continue
        ends = [m.span() for m in re.compile(borders).finditer(text, lo, hi)] + [(hi, hi)]
        for a, (b, after) in zip([lo, *(e for _, e in ends)], ends):
            start = end = None
            for s in re.compile(SENTENCE).finditer(text, a, b):
                if not s[0].strip():
                    continue
                if start is not None and s.end() - start > size:
                    spans.append((start, end))
                    start = max(start, end - overlap) if overlap and s.end() - s.start() <= size else None
                if s.end() - s.start() > size:
                    spans += [(s.start() + x, s.start() + y) for x, y in recursive_spans(s[0], size, overlap, separators)]
                    start = None
                    continue
                start, end = s.start() if start is None else start, s.end()
            if start is not None:
                spans.append((start, end))
    return spans


def regex_spans(text: str, pattern: str) -> list[tuple[int, int]]:
    """Matches and the gaps between them, blank ones left out."""
    spans, at = [], 0
    for m in re.finditer(pattern, text):
        spans += [(at, m.start()), m.span()]
        at = m.end()
    return [(a, b) for a, b in [*spans, (at, len(text))] if text[a:b].strip()]


def chunked(docs: DataFrame, id_col: str, text_col: str, spans: Callable[..., list[tuple[int, int]]], given: list[str] | None = None) -> DataFrame:
    """The chunks of each text by a function that gives spans: id, chunk_index, text, char_start, char_end. Null texts have none.

    ``given`` names further columns of ``docs`` that the function takes after the text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for part in pa.Table.from_batches([batch]).to_batches(max_chunksize=512):
                at, found = [], []
                more = [part.column(2 + k).to_pylist() for k in range(len(given or []))]
                for i, text in enumerate(part.column(1).to_pylist()):
                    for n, (a, b) in enumerate(spans(text, *(m[i] for m in more)) if text else []):
                        at.append(i)
                        found.append((n, text[a:b], a, b))
                columns = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *columns], names=["id", "chunk_index", "text", "char_start", "char_end"])

    rows = docs.select(F.col(id_col), F.col(text_col), *(given or [])).mapInArrow(cut, f"id {kind}, chunk_index int, text string, char_start int, char_end int")
    return rows.withColumnRenamed("id", id_col)


def with_ranges(docs: DataFrame, ranges: DataFrame, id_col: str, name: str) -> DataFrame:
    """Adds ``name``: the ranges (start, end) of each document in order, an empty array for none."""
    listed = ranges.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias(name))
    return docs.join(listed, id_col, "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<start:bigint,end:bigint>>")))


def _pairs(ranges: list[dict]) -> list[tuple[int, int]]:
    return [(r["start"], r["end"]) for r in ranges]


def fitted_spans(size: int, overlap: int = 0) -> Callable[..., list[tuple[int, int]]]:
    """A function of a text, its sections and its protected ranges: sections as they are up to ``size``, longer ones cut recursively within their borders."""

    def spans(text: str, sections: list[dict], protected: list[dict]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in (bare for s in _pairs(sections) for bare in _bare(text, *s)):
            inner = [r for r in _pairs(protected) if r[0] < b and r[1] > a]
            out += [(a, b)] if b - a <= size else [(a + x, a + y) for x, y in recursive_spans(text[a:b], size, overlap, protected=inner, at=a) if text[a + x : a + y].strip()]
        return out

    return spans


def parent_spans(size: int, most: int = 50_000) -> Callable[..., list[tuple[int, int]]]:
    """A function of a text, its sections, finer sections and protected ranges: sections whole, but those beyond ``most``
    as runs of finer sections that fit ``size``, and a finer one beyond that cut recursively."""

    def spans(text: str, sections: list[dict], finer: list[dict], protected: list[dict]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in _pairs(sections):
            if b - a <= most:
                out += _bare(text, a, b)
                continue
            run: tuple[int, int] | None = None
            for x, y in (r for r in _pairs(finer) if a <= r[0] < b):
                if run and y - run[0] > size:
                    out += _bare(text, *run)
                    run = None
                if y - x > size:
                    inner = [r for r in _pairs(protected) if r[0] < y and r[1] > x]
                    out += [e for lo, hi in recursive_spans(text[x:y], size, protected=inner, at=x) for e in _bare(text, x + lo, x + hi)]
                else:
                    run = (run[0] if run else x, y)
            out += _bare(text, *run) if run else []
        return out

    return spans


def with_parents(children: DataFrame, parents: DataFrame, id_col: str) -> DataFrame:
    """Adds parent_chunk_index: the parent in which the child starts, else the nearest before it, else the first.

    Parents of a document do not overlap. An as-of look over children and parents in order of their starts,
    so no child meets all parents; null where there is none.
    """
    marks = parents.select(id_col, F.col("char_start"), F.col("chunk_index").alias("_parent"))
    both = children.withColumns({"_parent": F.lit(None).cast("int"), "_child": F.lit(True)}).unionByName(marks.withColumn("_child", F.lit(False)), allowMissingColumns=True)
    document = Window.partitionBy(id_col)
    upto = document.orderBy("char_start", "_child").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("parent_chunk_index", F.coalesce(F.last("_parent", ignorenulls=True).over(upto), F.min("_parent").over(document)))
    return found.where("_child").drop("_parent", "_child")


def question_statistics(docs: DataFrame, id_col: str, text_col: str, least_share: float = 0.5) -> DataFrame:
    """Of every document: id, pairs (paragraphs with a question), segments, valid (pairs make up ``least_share`` of the segments).

    What follows a question up to the next belongs to it, and so does a single paragraph before the
    first; more paragraphs there, and those of a text without questions, are segments each.
    """
    paragraphs = pieces_of(docs, id_col, text_col, r"\n\s*\n").where(F.col("piece").rlike(r"(?U)\S"))
    numbered = paragraphs.select(id_col, F.col("piece").rlike(QUESTION).alias("q"), (F.row_number().over(Window.partitionBy(id_col).orderBy("n")) - 1).alias("i"))
    counted = numbered.groupBy(id_col).agg(F.count_if("q").alias("pairs"), F.count("*").alias("all"), F.min(F.when(F.col("q"), F.col("i"))).alias("first"))
    segments = F.when(F.col("first").isNull(), F.col("all")).otherwise(F.col("pairs") + F.when(F.col("first") > 1, F.col("first")).otherwise(0))
    out = docs.select(id_col).join(counted, id_col, "left").select(id_col, F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce(segments, F.lit(0)).alias("segments"))
    return out.withColumn("valid", (F.col("segments") > 0) & (F.col("pairs") >= least_share * F.col("segments")))


def merged_ranges(ranges: DataFrame, id_col: str) -> DataFrame:
    """Overlapping or touching ranges (start, end) of an id as one: id, start, end."""
    order = Window.partitionBy(id_col).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    run = marked.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(id_col, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
