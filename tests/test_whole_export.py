"""The export of whole messages."""

import pytest

from corpusmill.plans import QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_session_export_has_whole_messages(spark, folder):
    long = "é" * 700 + " end"
    at = folder("conversations", [(1, 1, "assistant", long), (1, 0, "user", "ask"), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.markdown for r in QUERIES["session_export"](spark, at).collect()}
    assert got == {1: f"**user** ask\n\n**assistant** {long}", 2: "**user** "}
