"""Pieces of a model's answer put back to their text, and what answers share with sources, against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import alignment as A
from corpusmill.operators import context as X
from corpusmill.operators import prompts as P

TEXT = "## Two\n\n### 2.1\nThe quick brown fox jumps over the lazy dog near the river bank.\n\nSecond paragraph stands here.\n### 2.2\nlast words"


def test_pieces_are_found():
    pieces = ["The quick  brown fox jumps", "over the lazy dog near the RIVER bank and more", "not here at all", "Second\nparagraph", "", None]
    spans = A.aligned_spans(TEXT, pieces)
    found = [s and TEXT[slice(*s)] for s in spans]
    assert found[0] == "The quick brown fox jumps" and found[1].strip() == "over the lazy dog near the" and found[2:] == [None, "Second paragraph", None, None]


def test_lost_headings_come_back(spark):
    rows = spark.createDataFrame([(1, TEXT, ["The quick brown fox jumps over the lazy dog", "Second paragraph stands here.", "last words"]), (2, "x", None), (3, None, ["a"]), (4, TEXT, ["### 2.2\nlast words"])], "doc_id int, text string, pieces array<string>")
    got = [(r.doc_id, r.text) for r in A.aligned_chunks(rows, "doc_id", "text", "pieces").orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, "## Two\n\n### 2.1\nThe quick brown fox jumps over the lazy dog"), (1, "Second paragraph stands here."), (1, "### 2.2\nlast words"), (4, "### 2.2\nlast words")]


def brute_highlights(answer, source, width=4, gap=2):
    answer = re.sub(r"\s", "", answer)
    grams = {answer[i : i + width] for i in range(len(answer) - width + 1)}
    images = [m.span() for m in re.finditer(r"!\[[^\]]*\]\([^)]*\)", source)]
    signs = [(i, None if any(a <= i < b for a, b in images) else c) for i, c in enumerate(source) if any(a <= i < b for a, b in images) or not c.isspace()]
    hit = [False] * len(signs)
    for i in range(len(signs) - width + 1):
        part = [c for _, c in signs[i : i + width]]
        if None not in part and "".join(part) in grams:
            hit[i : i + width] = [True] * width
    out, start, miss = [], None, 0
    for i, h in enumerate(hit):
        if h:
            if start is None or miss > gap:
                if start is not None:
                    out.append((start, end))
                start = signs[i][0]
            end, miss = signs[i][0] + 1, 0
        else:
            miss += 1
    return out + ([(start, end)] if start is not None else [])


def test_highlights(spark):
    cases = [("the lazy dog ran", "A the la zy dog and ![the lazy](dog) the lazy cat"), ("abcd efgh", "abcdxyefgh abcdxyzefgh"), ("abc", "abc"), ("", "text"), ("some", ""), ("aaaa", "aaaaaa"), ("é好🙂x y", "é好🙂xy é好")]
    rows = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(cases)], "i int, a string, s string")
    got = {}
    for r in A.highlights(rows, "i", "a", "s").orderBy("i", "start").collect():
        got.setdefault(r.i, []).append((r.start, r.end))
    assert got == {i: h for i, (a, s) in enumerate(cases) if (h := brute_highlights(a, s))}


def test_labels_images_and_external_results(spark):
    r = spark.createDataFrame([(" 事实类 ", "x"), ("odd", None), (None, "")], "l string, t string").select(A.label(F.col("l"))).collect()
    assert [x[0] for x in r] == ["事实类", "其他", "其他"]
    s = spark.createDataFrame([(1, 2, "b", "t ![i](/api/files/images/b.png)", ""), (1, 1, "a", "c", "p /api/files/images/a.png /api/files/images/b.png")], "query_id int, rank int, document_name string, text string, parent_text string")
    a = spark.createDataFrame([(1, "x" * 10), (2, None)], "query_id int, answer string")
    got = {r.query_id: r for r in P.external_results(a, s, most=5, most_source=3).collect()}
    assert got[1].answer == "xxxxx" and [tuple(x) for x in got[1].sources] == [("a", "p /"), ("b", "t !")] and got[1].images == ["/api/files/images/a.png", "/api/files/images/b.png"]
    assert got[2].sources == [] and got[2].images == []


def test_a_document_again(spark):
    m = spark.createDataFrame([("a", "b", "t", 1, 0), ("a", "c", "t", 2, 0)], "source string, target string, type string, doc_id long, chunk_index int")
    schema = "chunk_index int, entities array<string>, relations array<struct<source:string,target:string,type:string>>"
    fresh, state = X.document_again(m, 1, spark.createDataFrame([(0, ["x"], [("x", "y", "t")]), (1, None, None)], schema))
    assert sorted((r.source, r.doc_id) for r in fresh.collect()) == [("a", 2), ("x", 1)] and tuple(state.first()) == (1, 2, 1, "done")
    assert X.document_again(m, 1, spark.createDataFrame([(0, None, None)], schema))[1].first().status == "failed"
    assert X.document_again(m, 1, spark.createDataFrame([], schema))[1].first().status == "done"


def test_spans_are_in_order():
    assert A.aligned_spans("a b a b", ["a b", "a b", "a b"]) == [(0, 3), (4, 7), None]
    with pytest.raises(TypeError):
        A.aligned_spans(None, ["a"])


DOC = "背景介绍部分的内容说明文字。\n\n详细步骤包括安装软件包并配置参数。\n\n结尾总结部分的内容说明。"
PARTS = "第一段内容。\n\n第二段内容。\n\n第三段内容。"


def test_cases_of_pieces():
    slices = lambda text, pieces: [s and text[slice(*s)] for s in A.aligned_spans(text, pieces)]
    assert slices(DOC, DOC.split("\n\n")) == DOC.split("\n\n")
    assert slices(PARTS, ["第一段内容。第二段内容。", "第三段内容。"]) == ["第一段内容。\n\n第二段内容。", "第三段内容。"]
    first, changed, last = slices(DOC, ["背景介绍部分的内容说明文字。", "详细步骤包括安装软件包并设置参数。", "结尾总结部分的内容说明。"])
    assert changed == "详细步骤包括安装软件包并" and first + last == "背景介绍部分的内容说明文字。结尾总结部分的内容说明。"
    assert slices(PARTS, ["第一段内容。", "这是完全无关的乱写内容", "第三段内容。"]) == ["第一段内容。", None, "第三段内容。"]
    assert slices(PARTS, ["完全不存在的文本一", "完全不存在的文本二"]) == [None, None]
    assert slices("", ["x"]) == [None] and A.aligned_spans("abc", []) == [] and slices("abc", ["", "  "]) == [None, None]
    assert A.aligned_spans("重复句。\n\n独特句。\n\n重复句。", ["重复句。", "独特句。", "重复句。"]) == [(0, 4), (6, 10), (12, 16)]


def test_pieces_of_common_words():
    line = "the same line again. "
    text = line * 100 + "Now something else entirely. " + line * 100
    spans = A.aligned_spans(text, [line * 3, "Now something  else entirely.", line * 2])
    assert spans[0] == (0, 3 * len(line) - 1) and spans[1] == (2100, 2128) and spans[2] == (2129, 2129 + 2 * len(line) - 1)


def test_chain_is_longest():
    import random

    rng = random.Random(0)
    for _ in range(200):
        points = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(12))}, key=lambda p: (p[0], -p[1]))
        best = {}
        for n, (x, y) in enumerate(points):
            best[n] = 1 + max((best[m] for m, (u, v) in enumerate(points[:n]) if u < x and v < y), default=0)
        chain = A._chain(points)
        assert len(chain) == max(best.values(), default=0) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:]))


def test_random_cuts_with_edits_are_found():
    import random

    rng = random.Random(5)
    for _ in range(60):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(300)]
        text = " ".join(words)
        cuts = sorted(rng.sample(range(1, 300), 6))
        bounds = list(zip([0, *cuts], [*cuts, 300]))
        pieces = ["\n".join(words[a:b]) for a, b in bounds]
        starts = [len(" ".join(words[:a])) + (a > 0) for a, _ in bounds]
        assert A.aligned_spans(text, pieces) == [(s, s + len(p)) for s, p in zip(starts, pieces)]
        long = [n for n, (a, b) in enumerate(bounds) if b - a >= 30]
        for n in long:  # one word in the last quarter of the piece is another one
            a, b = bounds[n]
            at = b - (b - a) // 4
            changed = [*words[a:at], "Z", *words[at + 1 : b]]
            spans = A.aligned_spans(text, [*pieces[:n], " ".join(changed), *pieces[n + 1 :]])
            assert spans[n][0] == starts[n] and spans[n][1] >= starts[n] + len(" ".join(words[a:at])) and [s for i, s in enumerate(spans) if i != n] == [(s, s + len(p)) for i, (s, p) in enumerate(zip(starts, pieces)) if i != n]


def test_no_row_for_a_sign(spark):
    """Ranges and shares are found within a pair: neither a join nor a shuffle by grams."""
    rows = spark.createDataFrame([(1, "the lazy dog", "a lazy dog")], "i int, a string, s string")
    assert "Join" not in A.highlights(rows, "i", "a", "s")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in rows.select(X.shared_share(F.col("a"), F.col("s")))._jdf.queryExecution().toString()
    shares = spark.createDataFrame([("abcdef", "xabcdex"), (None, "abcd"), ("abcd", None), ("abc", "abc"), ("🙂🙂🙂🙂a", "🙂🙂🙂🙂")], "a string, s string")
    assert [round(r[0], 6) for r in shares.select(X.shared_share(F.col("a"), F.col("s"))).collect()] == [0.666667, 0.0, 0.0, 0.0, 0.5]


def test_no_object_for_a_gram():
    """A long text of rare grams is put back without a dictionary of them."""
    import random
    import tracemalloc

    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300_000))
    tracemalloc.start()
    (span,) = A.aligned_spans(text, [text[1000:200_000]])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "".join(text[slice(*span)].split()) == "".join(text[1000:200_000].split()) and most < 60 << 20
