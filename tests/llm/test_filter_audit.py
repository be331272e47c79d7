"""The filter audit against brute force over all orders, on odd rows too."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import filter_audit as A
from corpusmill.scratch import written

LONG = " ".join(f"w{i}" for i in range(150))
DOCS = [
    (5, LONG, "en", "x"), (1, LONG, "en", "x"), (1, LONG, "en", "x"), (9, LONG, None, "x"), (2, None, "de", "x"), (3, "", "de", None), (None, LONG, "en", "x"), (None, "", "", "x"),
    (4, "ABC DEF " * 80, "en", "x"), (6, LONG + " # &", "fr", "x"), (7, "É" * 50 + " B", "fr", "x"), (8, "a\x0bb c " * 200, "fr", "x"), (10, "x " * 99, "only", "x"), (11, LONG.upper(), "en", "x"), (12, "A" * 300_000, "en", "x"),
]
LABELS = [(5, 1, 0), (5, 0, None), (9, 1, 1), (3, 0, 1), (None, 1, 1), (11, None, None), (11, 1, 1), (99, 1, 1)]
FILTERS = {"A": "n_words < 100", "B": "100 * n_distinct < 80 * n_words", "C": "100 * n_upper > 10 * n_chars", "D": "symbol", "E": "repeated"}


def brute(docs, labels):
    rows = []
    for i, text, lang, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": bool(set("#$%&*|") & set(text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _, _ in docs),
        }
        mark = lambda k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)  # noqa: B023, E731
        rows.append((lang or "", {f for f in fails if fails[f]}, mark(1), mark(2)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                fails = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels):
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, repeated string")
    told = spark.createDataFrame(labels, "id long, quality int, toxic int")
    rows = A.with_repeated(written(A.measures(table), "measures"))
    rows = A.with_marks(rows, told, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return A.audit(rows, {k: F.expr(x) for k, x in FILTERS.items()}, "part", {"good": F.col("good"), "toxic": F.col("toxic")})


def test_all_orders_of_odd_rows(spark):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in run(spark, DOCS, LABELS).collect()}
    assert got == brute(DOCS, LABELS)


def test_empty_table(spark):
    found = run(spark, [], LABELS)
    assert found.collect() == [] and found.columns[-1] == "shapley"


def test_one_text_in_many_rows(spark):
    docs = [(i, "same " * 120, "en", "x") for i in range(200)] + [(1000 + i, f"{LONG} {i}", "en", "x") for i in range(100)]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in run(spark, docs, []).collect()}
    assert got["en", "EABCD", 1][:2] == (101, 199) and got == brute(docs, [])


def test_clashing_columns_and_bounds(spark):
    rows = spark.createDataFrame([("a", 1, 7), ("a", 0, 7), (None, None, 7)], "f string, mask int, rows int")
    got = {tuple(r) for r in A.audit(rows, {"x": F.col("mask") == 1}, "f").collect()}
    assert got == {("a", "x", 1, 1, 1, 0, 1, 1), ("", "x", 1, 1, 0, 0, 0, 0)}
    with pytest.raises(ValueError):
        A.audit(rows, {}, "f")
    with pytest.raises(ValueError):
        A.audit(rows, {"xy": F.col("mask") == 1}, "f")
