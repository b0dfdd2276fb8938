"""Every registered query of the engine's own operators equals its SQL on the smallest tables."""

import math

import duckdb
import pytest

from catchwork import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return db


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: (None if math.isnan(v) else v + 0.0) if isinstance(v, float) else v
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_equals_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    got = norm(df.columns, [tuple(r) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    want = duck.execute(sql)
    assert got == norm([d[0] for d in want.description], want.fetchall())

