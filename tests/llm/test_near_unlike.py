"""Near-dedup on families of unlike relatives: what is sent, and the bounds that exclude pairs."""

from types import SimpleNamespace

import numpy as np
from tests.llm.test_near import brute

from partita.llm import near


def family(n, words, gone, name):
    """Copies of one text (which is left out) with so many words replaced each."""
    draw, base = np.random.default_rng(n), [f"{name}{i}" for i in range(words)]
    for k in range(n):
        own = list(base)
        for at in draw.choice(words, gone, replace=False).tolist():
            own[at] = f"{name}{k}x{at}"
        yield " ".join(own)


def test_unlike_relatives_send_no_sets(spark, tmp_path, monkeypatch):
    docs = [(k, t) for k, t in enumerate(family(40, 300, 7, "w"))]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/d")
    asked, count = [], near._count
    monkeypatch.setattr(near, "_count", lambda state: asked.append(count(state)) or asked[-1])
    got = {tuple(r) for r in near.groups(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert got == brute(docs) and len({r[2] for r in got}) == 40
    assert sum(x for x, _ in asked) < 80  # of 780 pairs that are alike in part


def test_pairs_near_the_threshold(spark, tmp_path):
    texts = [*family(12, 300, 5, "a"), *family(8, 2060, 40, "b"), *family(8, 2500, 36, "c")]
    texts += [" ".join(f"d{i}" for i in range(2049 + 4)), " ".join(f"d{i}" for i in range(2048 - 100 + 4)), " ".join(f"d{i}" for i in range(700, 2049 + 4))]
    # 75 of 100 shingles and 74 of 100
    texts += [" ".join(f"e{i}" for i in range(104)), " ".join(f"e{i}" for i in range(79)), " ".join(f"f{i}" for i in range(104)), " ".join(f"f{i}" for i in range(78))]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    got = {tuple(r) for r in near.groups(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert got == brute(docs)
    label = {r[0]: r[2] for r in got}
    assert label[len(docs) - 3] == len(docs) - 4 and label[len(docs) - 1] == len(docs) - 1


def test_prints_bound_what_sets_share():
    draw = np.random.default_rng(5)
    pool = draw.integers(0, 1 << 64, 4000, dtype=np.uint64)
    size = np.array([1, 300, 2048, 2049, 2600, 300, 2700])
    sets = [np.sort(draw.choice(pool, k, replace=False)) for k in size]
    s = SimpleNamespace(csize=size, values=np.concatenate(sets), cuts=np.concatenate([[0], np.cumsum(size)]))
    parts = [near._Prints.sent(s, np.array(x)) for x in ([0, 1, 2, 3], [4], [5, 6])]
    prints = near._Prints(size, [p[0] for p in parts], [p[1] for p in parts])
    for hub in range(len(size)):
        for members in ([k for k in range(len(size)) if k != hub], [k for k in range(len(size)) if k != hub and size[k] > 2048]):
            true = np.array([len(np.intersect1d(sets[hub], sets[k])) for k in members])
            most = prints.most(hub, np.array(members))
            assert (most >= true).all() and (most <= true + 0.06 * size[members] + 1).all()


def test_a_hub_outside_the_bucket_connects():
    got = near._local_components(np.array([1, 2, 3, 5, 8]), np.array([0, 2, 2, 4]), np.array([9, 9, 5, 8]))
    assert got.tolist() == [0, 1, 0, 0, 4]
