"""Queries of text structure: headings, protected ranges, sections, chains of headings, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prompts as P
from ..operators import structure as S
from ..sources.tables import table
from .registry import query

#: Every document's lines with marks of structure: headings of several styles, fences, tables.
RICH_SQL = r"""(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE i % 9
WHEN 1 THEN '# ' || substring(l, 1, 20) WHEN 3 THEN '=== ' || doc_id || ' ===' WHEN 4 THEN '```' WHEN 5 THEN '# inside' WHEN 6 THEN '```' WHEN 7 THEN '■ mark ' || i WHEN 8 THEN '### ' || (doc_id % 7) ELSE l END), chr(10)) AS text FROM documents)"""


def rich(spark, sf_dir):
    of = {4: "```", 5: "# inside", 6: "```"}

    def line(l, i):  # noqa: E741
        n = (i + 1) % 9
        c = F.when(n == 1, F.concat(F.lit("# "), F.substring(l, 1, 20))).when(n == 3, F.concat(F.lit("=== "), F.col("doc_id").cast("string"), F.lit(" ===")))
        for k, mark in of.items():
            c = c.when(n == k, F.lit(mark))
        return c.when(n == 7, F.concat(F.lit("■ mark "), (i + 1).cast("string"))).when(n == 8, F.concat(F.lit("### "), (F.col("doc_id") % 7).cast("string"))).otherwise(l)

    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


LINES_SQL = f"""lines AS (SELECT doc_id, i, p, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 - length(p) AS a, text, count(*) OVER (PARTITION BY doc_id) AS k
FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {RICH_SQL})),
fences AS (SELECT doc_id, a AS fs, coalesce(lead(a) OVER w + 3, length(text)) AS fe, row_number() OVER w AS r FROM lines WHERE i % 9 IN (4, 6) WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


@query(f"WITH {LINES_SQL} SELECT doc_id, fs::BIGINT AS \"start\", fe::BIGINT AS \"end\" FROM fences WHERE r % 2 = 1")
def protected_ranges(spark, sf_dir):
    return S.protected_ranges(rich(spark, sf_dir), "doc_id", "text").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


HEADS_SQL = r"""heads AS (SELECT doc_id, i, a, CASE i % 9 WHEN 1 THEN 1 WHEN 8 THEN 3 ELSE 2 END AS level,
CASE i % 9 WHEN 1 THEN trim(regexp_extract(p, '^#\s+(.+?)\s*$', 1)) WHEN 3 THEN doc_id::VARCHAR WHEN 7 THEN 'mark ' || i ELSE (doc_id % 7)::VARCHAR END AS title
FROM lines WHERE (i % 9 IN (3, 7, 8) OR (i % 9 = 1 AND regexp_matches(p, '^#\s+\S'))))"""


@query(f"WITH {LINES_SQL}, {HEADS_SQL} SELECT doc_id, (i - 1)::BIGINT AS n, a::BIGINT AS \"start\", level, title FROM heads")
def headings(spark, sf_dir):
    """Headings of every style. The lines between carry no marks of their own."""
    return S.headings(rich(spark, sf_dir), "doc_id", "text").select("doc_id", F.col("n").cast("long").alias("n"), F.col("start").cast("long").alias("start"), "level", "title")


STARTS_SQL = """chains AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM heads WHERE level <= 2),
sized AS (SELECT *, count(*) OVER w AS size, min(i) OVER w AS lo, max(i) OVER w AS hi FROM chains WINDOW w AS (PARTITION BY doc_id, island)),
firsts AS (SELECT doc_id, min(i) AS f FROM lines WHERE regexp_matches(p, '\\S') GROUP BY doc_id),
starts AS (SELECT sized.doc_id, a FROM sized JOIN firsts USING (doc_id) WHERE size = 1 OR (i = hi AND f < lo))"""


@query(f"""WITH {LINES_SQL}, {HEADS_SQL}, {STARTS_SQL}, points AS (SELECT doc_id, a FROM starts UNION SELECT doc_id, 0 FROM {RICH_SQL}),
ends AS (SELECT p.doc_id, a, coalesce(lead(a) OVER (PARTITION BY p.doc_id ORDER BY a), length(text)) AS b FROM points p JOIN {RICH_SQL} t ON t.doc_id = p.doc_id)
SELECT doc_id, a::BIGINT AS "start", b::BIGINT AS "end" FROM ends WHERE b > a""")
def sections(spark, sf_dir):
    """Sections at headings of level 2 or above."""
    return S.sections(rich(spark, sf_dir), "doc_id", "text", 2).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""WITH {LINES_SQL}, {HEADS_SQL}, ones AS (SELECT doc_id, i, a, level, title, max(CASE WHEN level = 1 THEN i END) OVER w AS i1, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1 FROM heads WHERE level <> 2 WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT doc_id, a::BIGINT AS "start", CASE WHEN level = 1 THEN title WHEN t1 IS NULL THEN title ELSE t1 || ' > ' || title END AS path FROM ones""")
def heading_chains(spark, sf_dir):
    return S.heading_chains(rich(spark, sf_dir), "doc_id", "text").select("doc_id", F.col("start").cast("long").alias("start"), "path")


@query()
def title_chunks(spark, sf_dir):
    """Chunks by headings of every style, up to 500 signs."""
    return S.title_chunks(rich(spark, sf_dir), "doc_id", "text", size=500, level=2)


@query()
def parent_child(spark, sf_dir):
    return S.parent_child_chunks(rich(spark, sf_dir), "doc_id", "text", parent_size=2000, child_size=300)[0]


@query()
def document_profiles(spark, sf_dir):
    """What is known of each text before it is chunked, and the chunker to take."""
    return P.profiles(table(spark, sf_dir, "documents"), "doc_id", "text", threshold=2_000)


@query(r"""WITH parts AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS ps FROM {SOURCE})),
numbered AS (SELECT doc_id, regexp_matches(p, '(?m)^\s*(?:Q|q)\s*:') AS q, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM parts WHERE regexp_matches(p, '\S')),
counted AS (SELECT doc_id, count(*) FILTER (q) AS pairs, count(*) AS n, min(n) FILTER (q) AS f FROM numbered GROUP BY doc_id),
told AS (SELECT d.doc_id, coalesce(pairs, 0) AS pairs, coalesce(CASE WHEN f IS NULL THEN n ELSE pairs + CASE WHEN f > 1 THEN f ELSE 0 END END, 0)::BIGINT AS segments FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id)
SELECT doc_id, pairs, segments, segments > 0 AND pairs >= 0.5 * segments AS valid FROM told""".replace("{SOURCE}", "(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i + doc_id) % 4 = 2 THEN 'Q: ' || l ELSE l END), chr(10) || chr(10)) AS text FROM documents)"))
def question_statistics(spark, sf_dir):
    """How far a document is made of questions and answers."""
    from ..operators.chunking import question_statistics as statistics

    line = lambda l, i: F.when((i + 1 + F.col("doc_id")) % 4 == 2, F.concat(F.lit("Q: "), l)).otherwise(l)  # noqa: E731, E741
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n\n").alias("text"))
    return statistics(d, "doc_id", "text")
