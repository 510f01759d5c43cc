"""Every registered operator against its DuckDB text, and the others against plain values."""

import duckdb
import numpy as np
import pytest

from partita.plans import catalog, registry, special

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in catalog.TABLES:
        db.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return db


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(x):
        if x is None:
            return ""
        if isinstance(x, float):
            return f"{x:.4f}".replace("-0.0000", "0.0000")
        return str(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_registered(spark, db, name):
    want = db.execute(registry.ORACLE[name])
    names = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(special.ORACLE))
def test_special(spark, db, name):
    want = db.execute(special.ORACLE[name])
    names = [c[0] for c in want.description]
    got = special.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


def test_spanning_tree_is_least(spark):
    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in registry.view(spark, DIR, "vectors").where("vec_id < 60").collect()}
    ids = sorted(v)
    x = np.array([v[i] for i in ids])
    norm = np.sqrt((x**2).sum(axis=1))
    dist = 1 - x @ x.T / (np.outer(norm, norm) + 1e-10)
    inside, total = {0}, 0.0
    while len(inside) < len(ids):
        d, j = min((dist[i, j], j) for i in inside for j in range(len(ids)) if j not in inside)
        inside.add(j)
        total += d
    from partita.operators import vectors

    tree = vectors.spanning_tree(registry.view(spark, DIR, "vectors").where("vec_id < 60")).collect()
    assert len(tree) == len(ids) - 1
    assert abs(sum(r.dist for r in tree) - total) < 1e-6


def test_components_against_numpy(spark):
    from partita.operators import vectors

    rows = registry.view(spark, DIR, "vectors").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    x = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    got = np.array([(r.p1, r.p2) for r in vectors.pca(registry.view(spark, DIR, "vectors")).orderBy("vec_id").collect()])
    assert np.abs(got - x @ axes).max() < 1e-3
