"""Suffix arrays and byte-string dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from partita.llm import suffixes
from partita.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute(docs, window):
    raw = [(k, (t or "").encode()) for k, t in docs]
    met = Counter(b[i : i + window] for _, b in raw for i in range(len(b) - window + 1))
    for k, b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - window + 1):
            if met[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        yield k, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 200):
        strings = [rng.integers(0, letters, int(m)).astype(np.uint8).tobytes() for m in rng.integers(1, 90, 30)]
        strings += strings[:5]
        data, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
        start = np.cumsum(size) - size
        order, rank = suffixes.suffix_array(data, start, size)
        tail = {int(a) + i: s[i:] for a, s in zip(start, strings, strict=True) for i in range(len(s))}
        got = [tail[p] for p in order.tolist()]
        assert got == sorted(got) and sorted(order.tolist()) == list(range(len(data))) and (order[rank] == np.arange(len(data))).all()
        most = 40
        prefix = suffixes.common_prefixes(data, start, size, order, rank, most)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            x, y = tail[a], tail[b]
            want = next((i for i in range(min(len(x), len(y), most)) if x[i] != y[i]), min(len(x), len(y), most))
            assert prefix[b] == want


@pytest.mark.parametrize(("shard", "hot"), [(1 << 20, 2000), (300, 2000), (1 << 20, 1)])
def test_small_windows(spark, shard, hot):
    rng = np.random.default_rng(7)
    part = ["".join(rng.choice(list("abé \n\0"), 60)) for _ in range(6)]
    docs = [(i, "".join(part[j] + "xyzw"[rng.integers(4)] * int(rng.integers(3)) for j in rng.integers(0, 6, int(rng.integers(0, 8))))) for i in range(60)]
    docs += [(None, None), (None, ""), (3, "a" * 700), (-9, docs[5][1]), (3, "b")]
    given = spark.createDataFrame(docs, SCHEMA).repartition(3)
    path = suffixes.dedup(suffixes.checkpointed(given), window=50, n_owners=3, shard=shard, hot=hot)
    assert ordered(path.collect()) == ordered(brute(docs, 50))


def test_empty(spark):
    assert suffixes.dedup(spark.createDataFrame([], SCHEMA), n_owners=2).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op3_suffix_array_dedup"](spark, DIR).collect()
    assert ordered(got) == ordered(brute(docs, 400)) and any(r.n_removed for r in got)
