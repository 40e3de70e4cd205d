"""Every query against its SQL in DuckDB, on the smallest tables."""

import decimal

import duckdb
import pytest

from tallyforge import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v + 0.0 if isinstance(v, float) else v


def canonical(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, db, name):
    found, want = QUERIES[name](spark, DATA), db.sql(ORACLE[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert canonical(found.columns, found.collect()) == canonical(want.columns, want.fetchall())


def test_diagnostics_against_numpy(spark):
    import numpy as np

    rows = QUERIES["io_coefficients"](spark, DATA).collect()
    a = np.zeros((5, 5))
    for r in rows:
        a[r.i, r.j] = r.a
    found = QUERIES["io_diagnostics"](spark, DATA).first()
    assert found.condition == pytest.approx(np.linalg.cond(np.eye(5) - a), abs=1e-4)
    assert found.radius == pytest.approx(np.abs(np.linalg.eigvals(a)).max(), abs=1e-4)
