"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from lakefold.plans import catalog
from lakefold.sources.tables import TABLES
from tables_dir import DATA


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.select(*[df[c] for c in cols]).collect()]
    if name not in catalog.ORACLE:
        assert rows
        return
    found = db.sql(catalog.ORACLE[name])
    assert sorted(found.columns) == cols
    expected = found.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(map(tuple, expected), key=key)
