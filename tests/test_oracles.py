"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows of a stable schema."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{Path(sf) / t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, sf, db, name):
    df = catalog.queries()[name](spark, sf)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(catalog.oracles()[name])
    assert found == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_query_without_sql_runs(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert df.count() >= 0 and df.columns


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 277
