"""Headings, protected ranges, sections and chunkers on small texts."""

from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import structure as S

TEXT = "# A\nx\n```py\n# no\n```\n## B\ny\n====== C ======\nz\n■ D mark\nTitle\n=====\nq\nSub\n----\nr\n========\nafter\n【E】\nlabel:\n----\n| a | b |\n\n| --- | --- |\n# c\n<table><tr>\n# in\n</table> t\n# Z1\n# Z2\nbody"


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def cut(df, text):
    return [text[r.start : r.end] for r in df.orderBy("start").collect()]


def test_protected_ranges(spark):
    assert cut(S.protected_ranges(frame(spark, TEXT), "doc_id", "text"), TEXT) == ["```py\n# no\n```", "| a | b |\n\n| --- | --- |", "<table><tr>\n# in\n</table>"]
    odd = "```\na\n```x\nb\n```\nc\n```\nd"
    assert cut(S.protected_ranges(frame(spark, odd), "doc_id", "text"), odd) == ["```\na\n```x\nb\n```", "```\nd"]
    lone = "| not a table |\ntext\n<TABLE x> open"
    assert cut(S.protected_ranges(frame(spark, lone), "doc_id", "text"), lone) == ["<TABLE x> open"]


def test_headings_of_every_style(spark):
    got = [(r.level, r.title) for r in S.headings(frame(spark, TEXT), "doc_id", "text").orderBy("n").collect()]
    assert got == [(1, "A"), (2, "B"), (2, "C"), (2, "D mark"), (1, "Title"), (2, "Sub"), (1, "r"), (2, "E"), (1, "c"), (1, "Z1"), (1, "Z2")]
    none = "====\n====\n----\n<tag>\n----\n| x |\n----\nends:\n----\n" + "long " * 20 + "\n====\n*** ***\n####### seven\n#tight"
    assert [r.title for r in S.headings(frame(spark, none), "doc_id", "text").collect()] == []
    assert {r.title for r in S.headings(frame(spark, "━━ wide ━━\n*** star ***\n--- dash ---\n▶go"), "doc_id", "text").collect()} == {"wide", "star", "dash", "go"}


def test_sections(spark):
    assert cut(S.sections(frame(spark, TEXT), "doc_id", "text", 2), TEXT)[:3] == ["# A\nx\n```py\n# no\n```\n", "## B\ny\n", "====== C ======\nz\n■ D mark\n"]
    # headings on neighbouring lines: only the last begins a section, and none at the head of a text
    text = "# one\n## two\nbody\n# three\n## four\nmore"
    assert cut(S.sections(frame(spark, text), "doc_id", "text", 2), text) == ["# one\n## two\nbody\n# three\n", "## four\nmore"]
    # one long section: a level deeper
    deep = "## p\ntext " + "w " * 60 + "\n### r\nmore"
    assert len(cut(S.sections(frame(spark, deep), "doc_id", "text", 2), deep)) == 1
    assert cut(S.sections(frame(spark, deep), "doc_id", "text", 2, size=50), deep)[1] == "### r\nmore"
    assert S.sections(frame(spark, None, ""), "doc_id", "text", 2).count() == 0


def test_title_chunks_keep_tables_whole(spark):
    table = "\n".join(["| h | k |", "| --- | --- |"] + [f"| {i} | {i * i} |" for i in range(40)])
    text = "# T\n" + "word " * 50 + "\n" + table + "\n" + "tail " * 50
    rows = S.title_chunks(frame(spark, text, None, " \n"), "doc_id", "text", size=100, overlap=10).orderBy("chunk_index").collect()
    assert table in [r.text for r in rows] and all(r.text == text[r.char_start : r.char_end] for r in rows)
    assert all(len(r.text) <= 110 for r in rows if r.text != table)
    kept = S.sentence_chunks(frame(spark, text), "doc_id", "text", size=100).collect()
    assert table in [r.text for r in kept]


def test_parent_child(spark):
    text = "intro\n" + "".join(f"## S{i}\n" + f"line {i} " * 40 + "\n" for i in range(3))
    children, parents = S.parent_child_chunks(frame(spark, text), "doc_id", "text", parent_size=500, child_size=100, level=2)
    p = {r.chunk_index: r for r in parents.collect()}
    assert [r.text[:5] for r in sorted(p.values(), key=lambda r: r.chunk_index)] == ["intro", "## S0", "## S1", "## S2"]
    for c in children.collect():
        own = p[c.parent_chunk_index]
        assert own.char_start <= c.char_start and c.char_end <= own.char_end
    # a section beyond the bound is packed from finer ones
    big = S.parent_child_chunks(frame(spark, text), "doc_id", "text", parent_size=400, child_size=100, level=1, most=500)[1].collect()
    assert len(big) > 1 and all(len(r.text) <= 400 for r in big)


def test_heading_paths_are_added(spark):
    text = "# A\nx\n## B\nyy\n# C\nzz"
    chunks = spark.createDataFrame([(0, 0, "x", 4, 5), (0, 1, "yy", 11, 13), (0, 2, "# C\nzz", 14, 20), (1, 0, "free", 0, 4)], "doc_id long, chunk_index int, text string, char_start int, char_end int")
    got = {(r.doc_id, r.chunk_index): (r.text, r.char_start) for r in S.with_heading_paths(chunks, frame(spark, text, "free"), "doc_id", "text").collect()}
    assert got == {(0, 0): ("A\nx", 4), (0, 1): ("A > B\nyy", 11), (0, 2): ("# C\nzz", 14), (1, 0): ("free", 0)}


def test_delimiters():
    text = "one|two. three|four"
    assert [text[a:b] for a, b in C.sentence_spans(text, 8, delimiter=["|"])] == ["one", "two.", " three", "four"]
    assert [text[a:b] for a, b in C.sentence_spans(text, 8, delimiter=[])] == [text[a:b] for a, b in C.sentence_spans(text, 8)]
    assert C._delimited("|")[0] == "|" and C._delimited(["", "x"]) == ["x"]


def test_question_statistics(spark):
    texts = ["Title\n\nQ: a?\n\nanswer\n\nmore\n\nq：b?\nA: c", "one\n\ntwo\n\nQ: x", "no\n\nquestions", "", None]
    got = {r.doc_id: (r.pairs, r.segments, r.valid) for r in C.question_statistics(frame(spark, *texts), "doc_id", "text").collect()}
    assert got == {0: (2, 2, True), 1: (1, 3, False), 2: (0, 2, False), 3: (0, 0, False), 4: (0, 0, False)}


def test_parents_are_found_as_of(spark):
    children = spark.range(0, 1000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), (F.col("id") * 3).cast("int").alias("char_start"), (F.col("id") * 3 + 2).cast("int").alias("char_end"))
    parents = spark.range(0, 50).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), (F.col("id") * 60 + 7).cast("int").alias("char_start"), (F.col("id") * 60 + 66).cast("int").alias("char_end"))
    for r in C.with_parents(children, parents, "doc_id").collect():
        assert r.parent_chunk_index == max(0, (r.char_start - 7) // 60)
