"""The near-dedup stage on repeated and null doc_ids."""

from partita.llm import near


def test_one_row_of_each_group_stays(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(120))
    rows = [(7, text(0)), (7, text(0)), (3, text(0) + " end"), (5, text(1)), (5, text(2)), (None, text(3)), (None, text(3)), (None, text(3) + " end"), (None, text(2)), (9, text(4)), (None, ""), (None, None)]
    spark.createDataFrame([(k, t, "en", "s", n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = near.stage(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:4]) for r in kept.collect())
    assert got == [(False, 3, "w0x0"), (False, 5, "w1x0"), (False, 5, "w2x0"), (False, 9, "w4x0"), (True, 0, ""), (True, 0, ""), (True, 0, "w3x0")]
