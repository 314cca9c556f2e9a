"""Every registered query of the core against its SQL, at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from tessella import queries as core
from tessella.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, db, name):
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in core.SQL:
        return
    r = db.execute(core.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr) == got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(core.SQL) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
