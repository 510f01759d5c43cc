"""Every catalogue query against the same SQL in DuckDB."""

import duckdb
import pytest

from partita.plans import catalog

DIR = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("" if r[i] is None else f"{r[i]:.4f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_oracle(spark, name):
    db = duckdb.connect()
    for t in catalog.TABLES:
        db.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = db.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    got = catalog.query(name)(spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)
