"""Scores against plain counts, and the model against its base on held-out documents."""

import math
import re
import zlib
from collections import Counter

from partita.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_against_plain_counts(spark, tmp_path):
    given = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = [tuple(d) for d in given.collect()] + [(10**6 + i, t, None, None, 0) for i, t in enumerate([None, "", " \n", "A a É", "a\x1cb"])]
    spark.createDataFrame(docs, given.schema).repartition(3, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = {d[0]: [*re.findall(r"[^\x20\x09-\x0D]+", (d[1] or "").translate(LOWER)), None] for d in docs}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    count = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in QUERIES["op9_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got.keys() == tokens.keys()
    for k, t in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(w in count for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    out = [k for k in held if held[k]]
    assert sum(got[k].score for k in out) > sum(got[k].base_score for k in out)
