"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from rasterloom.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(v):
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else str(v)
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_all_have_sql():
    assert set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = sorted(names)
    a = sorted(repr([norm(r[k]) for k in key]) for r in got.collect())
    b = sorted(repr([norm(r[names.index(k)]) for k in key]) for r in want.fetchall())
    assert a == b
