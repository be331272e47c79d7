"""The structure of texts by lines: protected ranges, headings of every style, where sections begin.

All of it is relational over the lines of each document: windows by document, no text function that
sees a whole document. Offsets are code points of the full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import chunked, fitted_spans, merged_ranges, parent_spans, pieces_of, sentence_spans, with_parents, with_ranges

# The longest heading, marks before one, and signs that alone make no heading.
HEADING_CHARS = 50
MARKS = "■◆●※▶▍"
ORNAMENTS = "-=*~_#|+━─—·•●○■◆※▶▍"


#: A heading between equal signs: three or more on each side, two of a drawn line.
_WRAPPED = r"^(?:([=*-])\1{2,}+|([━─])\2++)(.+?)(?:\1{3,}|\2{2,})$"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, piece, start, end of each line."""
    return pieces_of(docs, id_col, text_col, r"\n")


def _by_line(id_col: str):
    return Window.partitionBy(id_col).orderBy("n")


def _fences(lines: DataFrame, id_col: str) -> DataFrame:
    """Fenced code, from the fence to the next one without a language, else to the end of the text.

    A bare fence opens or closes, one with a language can only open: whether a line is inside depends on
    the bare ones since the last that could only open.
    """
    upto = _by_line(id_col).rowsBetween(Window.unboundedPreceding, 0)
    fence, bare = F.col("piece").rlike(r"^`{3,}"), F.col("piece").rlike(r"^`{3,}\s*$")
    marked = lines.withColumns({"fence": fence, "bare": bare, "turns": F.sum(bare.cast("int")).over(upto)})
    marked = marked.withColumn("opened", F.last(F.when(F.col("fence") & ~F.col("bare"), F.col("turns")), ignorenulls=True).over(upto))
    inside = (F.col("turns") - F.coalesce("opened", F.lit(0)) + F.when(F.col("opened").isNull(), 0).otherwise(1)) % 2 == 1
    before = F.coalesce(F.lag(inside).over(_by_line(id_col)), F.lit(False))
    held = marked.withColumn("held", inside | before & F.col("bare")).withColumn("fresh", F.coalesce(~before & inside, F.lit(False)).cast("int"))
    runs = held.withColumn("run", F.sum("fresh").over(upto)).where("held")
    return runs.groupBy(id_col, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _tables(lines: DataFrame, id_col: str) -> DataFrame:
    """Markdown tables: rows with nothing but blank lines between, two at least and one of them a separator."""
    upto = _by_line(id_col).rowsBetween(Window.unboundedPreceding, 0)
    row = F.col("piece").rlike(r"^[ \t]*\|.*\|[ \t]*$")
    separator = F.col("piece").rlike(r"^[ \t]*\|(?=.*[^|\s])?[\s:|-]*\|[ \t]*$") & (F.translate("piece", "| \t", "") != "")
    other = (~row & (F.trim("piece") != "")).cast("int")
    rows = lines.withColumns({"run": F.sum(other).over(upto), "row": row, "sep": separator}).where("row")
    runs = rows.groupBy(id_col, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("k"), F.max("sep").alias("sep"))
    return runs.where("k >= 2 AND sep").select(id_col, "start", "end")


def _html_tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """From each ``<table`` to the next ``</table>``, else to the end of the text."""
    parts = pieces_of(docs, id_col, text_col, r"(?is)<table\b.*?(?:</table\s*>|\z)")
    order = Window.partitionBy(id_col).orderBy("n")
    # a table lies between a part's end and the start of the next
    return parts.select(id_col, F.col("end").alias("start"), F.lead("start").over(order).alias("end")).where("end > start")


def protected_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, start, end of what no chunk border may cut: Markdown tables, HTML tables, fenced code. Sorted apart, none overlap."""
    lines = lines_of(docs, id_col, text_col)
    found = _tables(lines, id_col).unionByName(_fences(lines, id_col)).unionByName(_html_tables(docs, id_col, text_col))
    return merged_ranges(found, id_col)


def outside(points: DataFrame, ranges: DataFrame, id_col: str) -> DataFrame:
    """``points`` (id, start and more) that do not lie within a range: an as-of look at the ranges that begin before."""
    marks = ranges.select(id_col, "start", F.col("end").alias("_reach"))
    both = points.withColumn("_reach", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True).withColumn("_point", F.col("_reach").isNull())
    # a range that begins at the point itself does not hold it
    before = Window.partitionBy(id_col).orderBy("start", F.desc("_point")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("_reach").over(before)
    return both.withColumn("_held", F.coalesce(reach > F.col("start"), F.lit(False))).where("_point AND NOT _held").drop("_reach", "_point", "_held")


def _sign_class(signs: str) -> str:
    return "[" + "".join(f"\\x{{{ord(s):x}}}" for s in signs) + "]"


def _plain(c: Column) -> Column:
    """May the text be a heading: not empty, not long, not ornaments alone."""
    return (c != "") & (F.length(c) <= HEADING_CHARS) & ~c.rlike(f"^(?:{_sign_class(ORNAMENTS)}|\\s)*$")


def headings(docs: DataFrame, id_col: str, text_col: str, protected: DataFrame | None = None, styles: bool = True) -> DataFrame:
    """id, n (line), start, level, title of each heading outside the protected ranges.

    ``#`` to ``######``; with ``styles`` also a line over ``====`` (level 1) or ``----`` (level 2), a line
    wrapped in signs or in 【】 and one after a mark (level 2).
    """
    lines = lines_of(docs, id_col, text_col).withColumn("under", F.lead("piece").over(_by_line(id_col)))

    def named(level: Column | int, title: Column) -> Column:
        return F.struct((F.lit(level) if isinstance(level, int) else level).alias("level"), title.alias("title"))

    def wrapped(bare: Column) -> Column:
        inner = F.concat(F.regexp_extract(bare, _WRAPPED, 3), F.regexp_extract(bare, "^【(.+)】$", 1))
        return let(F.trim(inner), lambda t: F.when(_plain(t), t))

    def style(bare: Column) -> Column:
        sharp = F.length(F.regexp_extract("piece", r"^(#{1,6})\s+.", 1))
        of = F.when(sharp > 0, named(sharp, F.regexp_extract("piece", r"(?U)^#{1,6}\s+(.+?)\s*$", 1)))
        if not styles:
            return of
        mark = F.when(F.length(bare) <= HEADING_CHARS, F.nullif(F.regexp_extract(bare, f"^{_sign_class(MARKS)}\\s*(.+)$", 1), F.lit("")))
        under = F.when(F.col("under").rlike(r"^[ \t]*={4,}[ \t]*$"), 1).when(F.col("under").rlike(r"^[ \t]*-{4,}[ \t]*$"), 2)
        setext = F.when(_plain(bare) & ~bare.rlike(r"^[<|]|[:：]$") & under.isNotNull(), named(under, bare))
        second = lambda t: F.when(t.isNotNull(), named(2, t))
        return F.coalesce(of, let(wrapped(bare), second), let(mark, second), setext)

    # bound once a line: the rules look at it often
    found = lines.where(F.col("piece").rlike(r"\S")).withColumn("h", let(F.regexp_replace("piece", r"(?U)^\s+|\s+$", ""), style))
    rows = found.where("h IS NOT NULL").select(id_col, "n", "start", "h.level", "h.title")
    return outside(rows, protected_ranges(docs, id_col, text_col) if protected is None else protected, id_col)


def section_starts(found: DataFrame, first_line: DataFrame, id_col: str, by: list[str] | None = None) -> DataFrame:
    """Headings at which a section begins: of headings on neighbouring lines only the last does, none if nothing precedes them.

    ``first_line``: id, first (the number of the first line that is not blank). ``by``: further keys, such as a level.
    """
    keys = [id_col, *(by or [])]
    islands = found.withColumn("_island", F.col("n") - F.row_number().over(Window.partitionBy(*keys).orderBy("n")))
    chain = Window.partitionBy(*keys, "_island")
    sized = islands.withColumns({"_size": F.count("*").over(chain), "_from": F.min("n").over(chain), "_to": F.max("n").over(chain)})
    kept = sized.join(first_line, id_col).where("_size = 1 OR (n = _to AND first < _from)")
    return kept.drop("_island", "_size", "_from", "_to", "first")


def first_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, first: the number of each text's first line that is not blank."""
    return lines_of(docs, id_col, text_col).where(F.trim(F.regexp_replace("piece", r"(?U)\s", " ")) != "").groupBy(id_col).agg(F.min("n").alias("first"))


def _sections(docs: DataFrame, starts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, start, end: the text before the first start, then from each start to the next; blank ones stay out where nothing is."""
    ends = docs.select(F.col(id_col), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_n"))
    points = starts.select(id_col, F.col("start").cast("long").alias("start")).unionByName(ends.select(id_col, F.lit(0).cast("long").alias("start"))).distinct()
    order = Window.partitionBy(id_col).orderBy("start")
    return points.join(ends, id_col).withColumn("end", F.coalesce(F.lead("start").over(order), F.col("_n"))).where("end > start").select(id_col, "start", "end")


def sections(docs: DataFrame, id_col: str, text_col: str, level: int, size: int | None = None, styles: bool = True) -> DataFrame:
    """id, start, end of the sections that begin at headings of ``level`` or above.

    With ``size``, a document with a single section longer than that is cut one level deeper, and again, as
    long as this gives further sections. Null and blank texts have one section, or none if empty.
    """
    found = headings(docs, id_col, text_col, styles=styles)
    first = first_lines(docs, id_col, text_col)
    levels = [level] if size is None else list(range(level, 7))
    at = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col("level"))).alias("at")
    starts = section_starts(found.select("*", at), first, id_col, ["at"])
    if size is not None:
        n = F.length(F.coalesce(F.col(text_col), F.lit("")))
        counted = starts.join(first, id_col).groupBy(id_col, "at").agg(F.count("*").alias("k"), F.min("start").alias("head"), (F.min("n") > F.first("first")).cast("int").alias("before"))
        every = docs.select(F.col(id_col), n.alias("_n"), F.explode(F.array(*map(F.lit, levels))).alias("at")).join(counted, [id_col, "at"], "left")
        one = F.coalesce(F.col("k") + F.col("before"), F.lit(1)) == 1
        alone = one & (F.when(F.coalesce("k", F.lit(0)) > 0, F.col("_n") - F.col("head")).otherwise(F.col("_n")) > size)
        told = every.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", alone.alias("alone"), F.coalesce("k", F.lit(0)).alias("k")))).alias("l"))
        # goes on while the level leaves one long section and the next has other headings
        onward = lambda s, x: F.when(s["stop"], s).when(s["alone"] & (x["k"] != s["k"]), F.struct(x["at"].alias("at"), x["alone"].alias("alone"), x["k"].alias("k"), F.lit(False).alias("stop"))).otherwise(F.struct(s["at"].alias("at"), s["alone"].alias("alone"), s["k"].alias("k"), F.lit(True).alias("stop")))
        begin = F.struct(F.col("l")[0]["at"].alias("at"), F.col("l")[0]["alone"].alias("alone"), F.col("l")[0]["k"].alias("k"), F.lit(False).alias("stop"))
        chosen = told.select(id_col, F.aggregate(F.slice("l", 2, F.size("l")), begin, onward)["at"].alias("at"))
        starts = starts.join(chosen, [id_col, "at"])
    return _sections(docs, starts, id_col, text_col)


def heading_chains(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, start, path: at each ``#`` heading the titles over it and its own, joined by " > ".

    A heading ends those of its level and below, so the title of a level counts if no heading of a
    level above came after it.
    """
    found = headings(docs, id_col, text_col, styles=False)
    upto = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"h{k}": F.last(F.when(F.col("level") == k, F.struct("n", "title")), ignorenulls=True).over(upto) for k in range(1, 7)}
    seen = found.withColumns(last)
    own = [F.when((F.col("level") >= k) & F.coalesce(F.col(f"h{k}.n") > F.greatest(F.lit(-1), *(F.coalesce(F.col(f"h{j}.n"), F.lit(-1)) for j in range(1, k)), F.lit(-1)), F.lit(False)), F.col(f"h{k}.title")) for k in range(1, 7)]
    return seen.select(id_col, "start", F.concat_ws(" > ", *own).alias("path"))


def with_heading_paths(chunks: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks whose text has no ``#`` heading get the chain of headings over them as a first line; offsets stay as they are."""
    chains = heading_chains(docs, id_col, text_col).select(id_col, F.col("start").cast("long").alias("_at"), F.col("path").alias("_path"))
    both = chunks.withColumns({"_at": F.col("char_start").cast("long"), "_path": F.lit(None).cast("string"), "_chunk": F.lit(True)}).unionByName(chains.withColumn("_chunk", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy(id_col).orderBy("_at", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    over = both.withColumn("_over", F.last("_path", ignorenulls=True).over(upto)).where("_chunk")
    bare = F.col("text").rlike(r"(?m)^#{1,6}\s+\S") | F.col("_over").isNull()
    return over.withColumn("text", F.when(bare, F.col("text")).otherwise(F.concat("_over", F.lit("\n"), "text"))).drop("_at", "_path", "_chunk", "_over")


def title_chunks(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0, level: int = 3) -> DataFrame:
    """Sections by headings of every style, whole up to ``size``, longer ones cut within: id, chunk_index, text, char_start, char_end."""
    given = with_ranges(docs.select(id_col, text_col), sections(docs, id_col, text_col, level, size), id_col, "_sections")
    given = with_ranges(given, protected_ranges(docs, id_col, text_col), id_col, "_protected")
    return chunked(given, id_col, text_col, fitted_spans(size, overlap), ["_sections", "_protected"])


def sentence_chunks(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0, delimiter: str | list[str] | None = None) -> DataFrame:
    """Whole sentences up to ``size``; tables and fenced code stay whole."""
    given = with_ranges(docs.select(id_col, text_col), protected_ranges(docs, id_col, text_col), id_col, "_protected")
    spans = lambda text, ranges: sentence_spans(text, size, overlap, delimiter, [(r["start"], r["end"]) for r in ranges])
    return chunked(given, id_col, text_col, spans, ["_protected"])


def parent_child_chunks(docs: DataFrame, id_col: str, text_col: str, parent_size: int, child_size: int, overlap: int = 0, level: int = 2, most: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Children with parent_chunk_index, and parents: sections at ``#`` headings of ``level``, children within sections of at most level 3."""
    given = docs.select(id_col, text_col)
    for name, depth in (("_sections", level), ("_finer", min(3, level))):
        given = with_ranges(given, sections(docs, id_col, text_col, depth, styles=False), id_col, name)
    given = with_ranges(given, protected_ranges(docs, id_col, text_col), id_col, "_protected")
    parents = chunked(given, id_col, text_col, parent_spans(parent_size, most), ["_sections", "_finer", "_protected"])
    children = chunked(given, id_col, text_col, fitted_spans(child_size, overlap), ["_finer", "_protected"])
    return with_parents(children, parents, id_col), parents
