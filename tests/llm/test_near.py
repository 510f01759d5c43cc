"""Near-duplicate groups against brute force."""

import re

import numpy as np

from partita.llm import near
from partita.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(docs):
    out = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(docs):
    s = sets(docs)
    label, ids = {k: k for k in s}, sorted(s)
    changed = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {(k, len(s[k]), label[k], label[k] == k) for k in s}


def test_against_brute_force(spark, tmp_path):
    given = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = [tuple(d) for d in given.collect()]
    base = " ".join(f"w{i}" for i in range(120))
    more = [None, "", " \n", "A b", "a B", "x " * 300, "x " * 301, docs[0][1]] + [base.replace(f" w{7 * i} ", f" v{i} ") for i in range(1, 17)] + [" ".join(f"w{i}" for i in range(8 * j, 8 * j + 100)) for j in range(25)]
    docs += [(10**6 + i, t, None, None, 0) for i, t in enumerate(more)]
    spark.createDataFrame(docs, given.schema).repartition(3, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["op5_minhash_near_dedup"](spark, str(tmp_path)).collect()} == brute([d[:2] for d in docs])


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        a = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
        b = np.concatenate([a[:200], draw.integers(0, 1 << 63, 100, dtype=np.uint64)])
        sig = near.signatures(np.repeat([0, 1], 300), np.concatenate([a, b]), 2)
        errors.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_empty(spark, tmp_path):
    spark.createDataFrame([], spark.read.parquet(f"{DIR}/documents.parquet").schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op5_minhash_near_dedup"](spark, str(tmp_path)).collect() == []
