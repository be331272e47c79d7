"""Queries of the chunkers, over whole documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..sources.tables import table
from .registry import query

#: Line-structured text: each second line of a document as a question or heading.
MARKED_SQL = r"""(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 4 = 2 THEN 'Q: ' || l WHEN i % 4 = 0 THEN '## ' || l ELSE l END), chr(10) || chr(10)) AS text FROM documents)"""


def marked(spark, sf_dir):
    line = lambda l, i: F.when((i + 1) % 4 == 2, F.concat(F.lit("Q: "), l)).when((i + 1) % 4 == 0, F.concat(F.lit("## "), l)).otherwise(l)  # noqa: E731, E741
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n\n").alias("text"))


_PARTS_SQL = """parts AS (SELECT doc_id, i, p, sum(length(p) + {gap}) OVER (PARTITION BY doc_id ORDER BY i) - {gap} AS e FROM (SELECT doc_id, unnest(string_split(text, {sep})) AS p, generate_subscripts(string_split(text, {sep}), 1) AS i FROM {source}))"""


@query(f"""WITH {_PARTS_SQL.format(gap=2, sep="chr(10) || chr(10)", source=MARKED_SQL)},
kept AS (SELECT *, sum(CASE WHEN starts_with(p, 'Q: ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM parts WHERE trim(p) <> ''),
spans AS (SELECT doc_id, run, min(e - length(p)) AS a, max(e) AS b FROM kept GROUP BY doc_id, run)
SELECT s.doc_id, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY run) - 1 AS INTEGER) AS chunk_index, m.text[a + 1 : b] AS text, a::INTEGER AS char_start, b::INTEGER AS char_end FROM spans s JOIN {MARKED_SQL} m ON m.doc_id = s.doc_id""")
def qa_chunks(spark, sf_dir):
    return C.question_chunks(marked(spark, sf_dir), "doc_id", "text")


@query(f"""WITH {_PARTS_SQL.format(gap=1, sep="chr(10)", source=MARKED_SQL)},
runs AS (SELECT *, sum(CASE WHEN regexp_matches(p, '^#{{1,2}}\\s+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM parts),
spans AS (SELECT doc_id, run, min(e - length(p)) AS a, max(e) AS b FROM runs GROUP BY doc_id, run)
SELECT s.doc_id, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY run) - 1 AS INTEGER) AS chunk_index, m.text[a + 1 : b] AS text, a::INTEGER AS char_start, b::INTEGER AS char_end FROM spans s JOIN {MARKED_SQL} m ON m.doc_id = s.doc_id""")
def title_sections(spark, sf_dir):
    return C.title_sections(marked(spark, sf_dir), "doc_id", "text")


@query()
def recursive_chunks(spark, sf_dir):
    return C.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", partial(C.recursive_spans, size=500, overlap=50))


@query()
def sentence_chunks(spark, sf_dir):
    return C.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", partial(C.sentence_spans, size=500))


LINE_PARTS_SQL = """(SELECT doc_id, i, p, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 - length(p) AS a FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}))"""
REGEX_SQL = "(SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, p AS text, a::INTEGER AS char_start, (a + length(p))::INTEGER AS char_end FROM " + LINE_PARTS_SQL + r" WHERE regexp_matches(p, '\S'))"


@query(f"SELECT * FROM {REGEX_SQL.format(source='documents')}")
def regex_chunks(spark, sf_dir):
    """Matches of a pattern and what lies between them: here the lines, since line ends are blank."""
    return C.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", partial(C.regex_spans, pattern=r"\n+"))


SECTION_STARTS_SQL = f"""(SELECT doc_id, 0 AS a FROM {MARKED_SQL} WHERE text <> '' UNION SELECT doc_id, a FROM {LINE_PARTS_SQL.format(source=MARKED_SQL)} WHERE regexp_matches(p, '^#{{1,2}}\\s+\\S'))"""


@query(f"""WITH parents AS (SELECT doc_id, a, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS parent_chunk_index FROM {SECTION_STARTS_SQL})
SELECT c.doc_id, chunk_index, char_start, char_end, parent_chunk_index FROM {REGEX_SQL.format(source=MARKED_SQL)} c ASOF JOIN parents p ON c.doc_id = p.doc_id AND c.char_start >= p.a""")
def parent_chunks(spark, sf_dir):
    """Lines as children of the sections they stand in."""
    m = marked(spark, sf_dir)
    children = C.chunked(m, "doc_id", "text", partial(C.regex_spans, pattern=r"\n+"))
    return C.with_parents(children, C.title_sections(m, "doc_id", "text"), "doc_id").select("doc_id", "chunk_index", "char_start", "char_end", "parent_chunk_index")


@query(f"""WITH l AS (SELECT doc_id, i, p, length(regexp_extract(p, '^(#{{1,6}})\\s+\\S', 1)) AS d, trim(regexp_replace(p, '^#+\\s*', '')) AS t FROM {LINE_PARTS_SQL.format(source=MARKED_SQL)}),
s AS (SELECT doc_id, i, {", ".join(f"max(CASE WHEN d = {k} THEN i END) OVER w AS i{k}, last_value(CASE WHEN d = {k} THEN t END IGNORE NULLS) OVER w AS t{k}" for k in (1, 2, 3))} FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT doc_id, (i - 1)::BIGINT AS n, concat_ws(' > ', t1, CASE WHEN i2 > coalesce(i1, 0) THEN t2 END, CASE WHEN i3 > greatest(coalesce(i1, 0), coalesce(i2, 0)) THEN t3 END) AS path FROM s""")
def heading_paths(spark, sf_dir):
    return C.heading_paths(marked(spark, sf_dir), "doc_id", "text").withColumn("n", F.col("n").cast("long"))


@query("""WITH r AS (SELECT doc_id % 40 AS g, doc_id AS a, doc_id + n_chars % 97 AS b FROM documents),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY g ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY g ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS fresh FROM r),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY g ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT g, min(a) AS "start", max(b) AS "end" FROM s GROUP BY g, run""")
def merged_ranges(spark, sf_dir):
    ranges = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("g"), F.col("doc_id").alias("start"), (F.col("doc_id") + F.col("n_chars") % 97).alias("end"))
    return C.merged_ranges(ranges, "g")


@query(r"""WITH c AS (SELECT doc_id, length(text) AS n, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), lambda w: w IN ('the', 'that', 'der', 'les', 'que'))) AS k FROM documents),
d AS (SELECT doc_id, CASE WHEN n > 0 THEN k * 1000.0 / n ELSE 0.0 END AS density FROM c)
SELECT doc_id, round(density, 4) AS density, CASE WHEN density >= 5 THEN 'high' WHEN density >= 2 THEN 'mid' ELSE 'low' END AS band FROM d""")
def reference_density(spark, sf_dir):
    """Reference words per 1000 characters, of every text; a null or empty one has none. Letters, marks and digits of any script are inside words."""
    d = table(spark, sf_dir, "documents")
    inside = r"[\p{L}\p{M}\p{N}_]"
    count = F.regexp_count(F.lower("text"), F.lit(f"(?<!{inside})(the|that|der|les|que)(?!{inside})"))
    density = F.when(F.length("text") > 0, count * 1000.0 / F.length("text")).otherwise(0.0)
    return d.select("doc_id", F.round(density, 4).alias("density"), F.when(density >= 5, "high").when(density >= 2, "mid").otherwise("low").alias("band"))


@query("SELECT doc_id, list_reduce(list_prepend(0, list_transform(string_split(text, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^\\s*(\\d+(\\.\\d+)*[.)]?\\s+\\S|(Chapter|Section|Part)\\s+\\d+)') THEN 1 ELSE 0 END)), lambda a, b: a + b)::BIGINT AS headings FROM documents")
def numbered_headings(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, lambda l: T.is_numbered_heading(l))).cast("long").alias("headings"))  # noqa: E741
