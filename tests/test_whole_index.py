"""What an index is made of travels as blocks, and blocks hold every posting however the chunks are cut into pages."""

import random
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa

from corpusmill.operators import keyword_index as K
from corpusmill.plans import QUERIES


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_postings_are_shuffled_once(spark, tmp_path):
    rng, path = random.Random(1), f"{tmp_path}/ix"
    rows = [(i, " ".join(f"w{w}" for w in rng.sample(range(100), 40))) for i in range(1000)]
    chunks = spark.createDataFrame(rows, "id long, text string")
    before = shuffled(spark)
    K.build(chunks, path, "id", "text")
    K.removed(chunks.where("id % 10 = 4"), path, "id")
    K.added(chunks.where("id % 10 = 4"), path, "id", "text")
    # 44,000 postings: 192,445 bytes, and 745,993 when postings were grouped first and the blocks then dealt again
    assert shuffled(spark) - before < 400_000
    assert {r.term: r.df for r in K.read(spark, path).terms.groupBy("term").agg({"df": "sum"}).toDF("term", "df").collect()} == Counter(w for _, t in rows for w in t.split())


def test_many_chunks_gone_are_found_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_BYTES", -1)
    rows, path = [(i, f"red w{i % 7}") for i in range(60)], f"{tmp_path}/ix"
    K.build(spark.createDataFrame(rows, "id long, text string"), path, "id", "text")
    K.removed(spark.createDataFrame([(i,) for i in range(0, 50, 2)], "id long"), path, "id")
    index = K.read(spark, path)
    left = Counter(w for i, t in rows if i >= 50 or i % 2 for w in t.split())
    assert {r.term: r["sum(df)"] for r in index.terms.groupBy("term").sum("df").collect()} == left and index.live_docs().count() == 35


def test_pages_of_any_cut_hold_all_postings(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(K, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(K, "PAGE_POSTINGS", 90)
    texts = [(f"c{i}", [f"w{int(rng.paretovariate(0.8)) % 50}" for _ in range(rng.choice([0, 1, 5, 60]))]) for i in range(200)]
    batches = [pa.RecordBatch.from_pylist([{"chunk_id": i, "t": t} for i, t in texts[a : a + 30]], pa.schema({"chunk_id": pa.string(), "t": pa.list_(pa.string())})) for a in range(0, 200, 30)]
    pages = list(K._pages(K._counted(b.slice(0) for b in batches), 7))
    blocks = [r for p in pages for r in p.to_pylist()]
    found = sorted((i, r["term"], tf, n) for r in blocks for i, tf, n in zip(r["chunk_ids"], r["tfs"], r["doc_lens"], strict=True))
    assert found == sorted((i, w, n, len(t)) for i, t in texts for w, n in Counter(t).items())
    assert len({(r["page"], r["term"]) for r in blocks}) == len(blocks) and {r["page"] >> 32 for r in blocks} == {3}
    assert all(r["most_tf"] == max(r["tfs"]) and r["least_len"] == min(r["doc_lens"]) and len(r["tfs"]) <= 7 for r in blocks)


def test_terms_are_counted_without_a_row_for_a_posting(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(40))) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/one/documents.parquet")
    before = shuffled(spark)
    found = sorted(map(tuple, QUERIES["index_terms"](spark, f"{tmp_path}/one").collect()))
    # 20,942 bytes, and 326,480 when each posting was a row
    assert shuffled(spark) - before < 60_000
    words = [t.split() for _, t in rows]
    df, occurrences = Counter(w for t in words for w in set(t)), Counter(w for t in words for w in t)
    assert found == sorted((w, df[w], occurrences[w]) for w in df)


def test_rows_of_one_id_count_as_one_chunk(spark, tmp_path):
    rows = [(1, "red red fox"), (1, "red hen"), (None, "fox cow"), (None, "fox"), (2, None), (3, ""), (4, "the 北京北京 x red"), (5, "北京 ⺀⺀ über")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/two/documents.parquet")
    found = {r.term: (r.df, r.occurrences) for r in QUERIES["index_terms"](spark, f"{tmp_path}/two").collect()}
    assert found == {"red": (2, 4), "fox": (2, 3), "hen": (1, 1), "cow": (1, 1), "北京": (2, 3), "京北": (1, 1), "⺀⺀": (1, 1), "über": (1, 1)}
