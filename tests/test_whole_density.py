"""Reference density of every text, against brute force."""

import re

import pytest

from corpusmill.plans import QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_reference_density_of_every_text(spark, sf_dir, folder):
    texts = ["", None, "Der Bär, der Länder", "le chèque que les élèves", "the éthe thé qué that_ THAT", "plain words", "“the” que—les"]
    at = folder("documents", list(enumerate(texts)), "doc_id long, text string")
    docs = [(at, dict(enumerate(texts))), (sf_dir, {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()})]
    for path, by_id in docs:
        got = {r.doc_id: (r.density, r.band) for r in QUERIES["reference_density"](spark, path).collect()}
        assert got.keys() == by_id.keys()
        for d, t in by_id.items():
            words = re.findall(r"[\ẁ-ͯ]+", (t or "").lower())
            per = sum(w in ("the", "that", "der", "les", "que") for w in words) * 1000 / len(t) if t else 0
            assert abs(got[d][0] - per) < 6e-5 and got[d][1] == ("high" if per >= 5 else "mid" if per >= 2 else "low"), t
