"""Streams with keyed state equal a fold over all rows, however the rows are cut into micro-batches."""

import datetime
import os
import random

import pytest

from corpusmill.streaming import keyed as K
from corpusmill.streaming.state import merged_memory


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, K.PROVIDER)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def streamed(spark, tmp_path, rows, schema, cuts, make, name):
    """The result of a stream that gets the rows in batches cut at ``cuts``."""
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        at = f"{tmp_path}/{name}/{n}"
        shuffled = rows[a:b]
        random.Random(n).shuffle(shuffled)
        spark.createDataFrame(shuffled, schema).coalesce(1).write.parquet(at)
        for f in os.listdir(at):
            os.utime(f"{at}/{f}", (1_000_000 + 100 * n,) * 2)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}/*")
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}-state").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return sorted(map(tuple, spark.table(name).collect()))


def test_contexts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), f"s{rng.randrange(6)}", i, f"q{i}", None if i % 7 == 0 else f"a{i}") for i in range(80)]
    want, held, born = [], {"a": {}, "b": {}}, 0
    for config, session, seq, q, a in rows:
        own, evicted = held[config], None
        if session not in own:
            if len(own) >= 3:
                evicted = min(own, key=lambda s: own[s][0])
                del own[evicted]
            own[session] = (born, [])
            born += 1
        own[session][1].extend(m for m in (q, a) if m)
        want.append((config, seq, session, own[session][1][-5:], evicted))
    schema = "config string, session string, seq long, question string, answer string"
    for n, cuts in enumerate(([], [13, 40, 41])):
        got = streamed(spark, tmp_path, rows, schema, cuts, lambda s: K.contexts(s, 3, 5), f"contexts{n}")
        assert got == sorted(want)


def test_gated_memory(spark, tmp_path):
    rng, day = random.Random(2), datetime.datetime(2024, 1, 1)
    rows, clock = [], {"u": 0, "v": 0}
    for i in range(60):
        user = rng.choice("uv")
        clock[user] += rng.choice([1, 2, 12])
        rows.append((user, sum(r[0] == user for r in rows), day + datetime.timedelta(minutes=clock[user]), [(f"likes {rng.randrange(5)}", rng.choice([0.4, 0.9, 1.0])) for _ in range(rng.randrange(3))] or None))
    want, state = [], {}
    for user, n, ts, found in rows:
        items, last, at = state.get(user, ([], None, None))
        if last is None or n - last >= 5 or (ts - at).total_seconds() >= 1800:
            items = merged_memory(items, found or [])
            state[user] = items, n, ts
            want.append((user, n, [tuple(i) for i in items]))
    schema = "user_id string, round long, ts timestamp, found array<struct<content: string, confidence: double>>"
    got = streamed(spark, tmp_path, rows, schema, [7, 30], K.gated_memory, "memory_rounds")
    assert [(u, n, [tuple(i) for i in items]) for u, n, items in got] == sorted(want) and 5 < len(want) < 60


def test_document_states(spark, tmp_path):
    rng, legal = random.Random(3), [("new", "parsing"), ("parsing", "ready"), ("parsing", "failed"), ("failed", "parsing")]
    rows = [(f"d{rng.randrange(4)}", i, rng.choice(["new", "parsing", "ready", "failed"])) for i in range(70)]
    want, state = [], {}
    for doc, seq, wanted in rows:
        now = state.get(doc, "new")
        want.append((doc, seq, now, wanted, (now, wanted) in legal))
        state[doc] = wanted if (now, wanted) in legal else now
    for n, cuts in enumerate(([], [1, 2, 50])):
        assert streamed(spark, tmp_path, rows, "doc_id string, seq long, wanted string", cuts, lambda s: K.document_states(s, legal, "new"), f"states{n}") == sorted(want)
