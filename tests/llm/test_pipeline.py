"""The pipeline's stages, each against the operator's verdicts on its own input."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from partita.llm import leaks, near, personal, quality

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, tables = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        tables.append(docs)
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert all(t.columns == tables[0].columns for t in tables)
    assert ids[1] == {r.doc_id for r in quality.report(tables[0]).collect() if r.kept}
    assert ids[2] == {r.doc_id for r in near.groups(tables[1]).collect() if r.kept}
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert ids[3] == {r.doc_id for r in leaks.matches(tables[2], items).collect() if r.kept}
    assert ids[4] == ids[3] and 0 < len(ids[4]) < len(ids[0])
    texts = {r.doc_id: r.text for r in tables[4].collect()}
    assert not any(personal.base_spans(t) for t in texts.values())
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in docs.collect():
        at[r.doc_id] = at.get(r.doc_id, 0) + r.length
    assert at == {k: 1 + len(tok.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
