"""Empty tables, null ids and clashing columns for every operator and stage."""

import pytest

from partita.llm import leaks, near, personal, quality
from partita.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
OPS = [n for n in QUERIES if n != "op10_chat_formatting"]


def written(spark, path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "some item text that is long enough to be matched with edits")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, tmp_path, name):
    assert QUERIES[name](spark, written(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("name", OPS)
def test_null_ids_and_texts(spark, tmp_path, name):
    rows = [(None, "a b c " * 40, None, None, None), (None, "a b c " * 40, None, None, None), (7, None, "en", None, None), (7, "", None, "x", 0), (8, "x", "en", "x", 1)]
    got = QUERIES[name](spark, written(spark, tmp_path, rows)).collect()
    assert {r.doc_id for r in got} == {None, 7, 8}
    assert name == "op2_packing" or len(got) == len(rows)


def test_empty_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in QUERIES["op10_chat_formatting"](spark, str(tmp_path)).collect()] == [-7]


@pytest.mark.parametrize("stage", [quality.stage, near.stage, personal.stage, lambda d: leaks.stage(d, d.sparkSession.createDataFrame([], "item_id long, text string"))])
def test_clashing_columns(spark, stage):
    extra = ["_m", "row", "gone", "own_lang", "_row", "_gone", "items", "spans", "at"]
    docs = spark.createDataFrame([(i, f"word{i} " + " ".join(f"w{j}x{i}" for j in range(80)), "en", "s", 1, *range(len(extra))) for i in range(3)], DOCS + "".join(f", `{c}` long" for c in extra))
    out = stage(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2]
