"""Window dedup against brute force."""

import hashlib
import re

from partita.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def test_against_brute_force(spark, tmp_path):
    given = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = [tuple(d) for d in given.collect()]
    docs += [(10**6 + i, t, None, None, 0) for i, t in enumerate([None, "", " \n", docs[0][1], "x " * 40, "x " * 40 + "é\x0by"])]
    spark.createDataFrame(docs, given.schema).repartition(3, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    words = {d[0]: re.findall(r"[^\x20\x09-\x0D]+", d[1] or "") for d in docs}
    least = {}
    for k in sorted(words):
        for i in range(len(words[k]) - 12):
            least.setdefault(tuple(words[k][i : i + 13]), k)
    want = set()
    for k, w in words.items():
        gone = {i + j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < k for j in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.add((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op7_substring_dedup"](spark, str(tmp_path)).collect()} == want
