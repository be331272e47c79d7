"""The fold of descriptions, against the reference's rule."""

from corpusmill.operators import graph as G


def folded(descriptions, most=200):
    old = ""
    for new in descriptions:
        if not old:
            old = new or ""
        elif new and new not in old:
            old = f"{old}；{new}"
        old = old[:most]
    return old


def test_descriptions_are_folded(spark):
    told = {"A": ["ab", "b", "cd", "ab", None, "", "cde"], "B": [f"part {i % 90}" for i in range(300)], "C": ["x" * 300, "y"], "D": ["z" * 150, "y" * 201, "y" * 202], "E": [None, ""]}
    rows = [(n, None if n == "A" else "t", d, i % 7, i // 7, 10 * i) for n, ds in told.items() for i, d in enumerate(ds)]
    found = spark.createDataFrame(rows[::-1], "name string, type string, description string, doc_id int, chunk_index int, seq long")
    got = {r.name: (r["count"], r.description) for r in G.merged_entities(found).collect()}
    assert got == {n: (len(ds), folded(ds)) for n, ds in told.items()}
    relations = found.withColumnsRenamed({"name": "source"}).selectExpr("*", "'Z' AS target")
    got = {r.source: (r.weight, r.description) for r in G.merged_relations(relations).collect()}
    assert got == {n: (len(ds), folded(ds)) for n, ds in told.items()}
    assert G.merged_relations(relations.drop("description")).columns == ["source", "target", "type", "weight"]
