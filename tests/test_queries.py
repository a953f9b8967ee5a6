"""Every registered query at the smallest scale, against its SQL twin where there is one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks vec_index entities relations chunk_entities graph_extract config"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CORE = [n for n in entry.registry.queries()]


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, base, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if sql := entry.oracle_sql().get(name):
        found = base.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted((tuple(_plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
        assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
